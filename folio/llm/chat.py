"""Chat formatting by multi-party perspective rotation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.llm.names import column
from folio.runtime import Scratch

START, END = "<|im_start|>", "<|im_end|>"
#: Characters of a rendered turn besides its role and text.
FRAME = len(f"{START}\n{END}\n")


def perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", narrator: str = "system") -> DataFrame:
    """The dialogue as each of its participants sees it.

    For every dialogue, participant and turn: the participant's own turns are the
    assistant's, all others' are those of users named after their speakers, the
    narrator's (never a participant) stay the system's. rendered is the turn in
    chat markup, char_start and char_end its place in the rendered dialogue, and
    mask_start and mask_end the span to train on: an assistant turn's text and
    end mark, null for all other turns. Markup in a text is broken up, so no text
    can open or end a turn.

    Turns go by number, then speaker and text; rows that repeat one come repeatedly.
    A null text is empty, a null speaker is called "unknown", null dialogue ids
    form one dialogue, null turn numbers come first. A dialogue may have any length
    and share of the rows: turns are dealt out by ranges of their order, and places
    are added up within the ranges of a dialogue and then over them.

    A perspective differs from the others only in its own turns' heads, so places
    need lengths and counts of turns; texts are joined and rendered last.
    """
    scratch = Scratch(turns.sparkSession, "chat")
    rows = turns.select(
        column(conv_col).alias("conv_id"),
        column(turn_col).cast("long").alias("turn"),
        F.coalesce(column(speaker_col).cast("string"), F.lit("unknown")).alias("speaker"),
        F.replace(F.coalesce(column(text_col), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "speaker", "text"]
    # equal rows are told apart as well, so that they needn't share a range
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order, "tie").sortWithinPartitions(*order, "tie").drop("tie")
    dealt = scratch.save(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "turns")
    name = F.regexp_replace("speaker", r"[^\p{L}\p{N}_.-]", "_")
    as_user = F.concat(F.lit("user name="), name)
    narrow = dealt.select("conv_id", "speaker", "part", "pos", (F.length(F.when(F.col("speaker") == narrator, "system").otherwise(as_user)) + F.length("text") + FRAME).alias("size"))
    who = dealt.where(F.col("speaker") != narrator).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"), (F.lit(len("assistant")) - F.length(as_user)).alias("shift")).distinct()
    up_to = lambda *by: W.partitionBy(*by).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    before = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    # places in the dialogue as if nobody were the assistant
    local = narrow.withColumns({"chars": before("size", up_to("conv_id", "part")), "turns": before(F.lit(1), up_to("conv_id", "part"))})
    parts = narrow.groupBy("conv_id", "part").agg(F.sum("size").alias("chars"), F.count("*").alias("turns"))
    ranges = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), before("chars", ranges).alias("chars_before"), before("turns", ranges).alias("turns_before"))
    placed = local.join(parts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv_id", "speaker", "part", "pos", (F.col("chars") + F.col("chars_before")).alias("chars"), (F.col("turns") + F.col("turns_before") + 1).alias("seq"))
    # how many turns each participant has had before
    seen = placed.join(who, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c").withColumn("own", (F.col("speaker") == F.col("perspective")).cast("long"))
    key = ["conv_id", "perspective", "part"]
    counted = seen.groupBy(*key).agg(F.sum("own").alias("own"))
    counted = counted.select(F.col("conv_id").alias("c"), F.col("perspective").alias("q"), F.col("part").alias("p"), before("own", W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("own_before"))
    seen = seen.withColumn("own_local", before("own", up_to(*key))).join(counted, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("q")) & (F.col("part") == F.col("p")))
    seen = seen.select("pos", "perspective", "seq", (F.col("chars") + F.col("shift") * (F.col("own_local") + F.col("own_before"))).alias("char_start"))
    out = dealt.join(seen, "pos")
    role = F.when(F.col("speaker") == narrator, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(F.lit(START), F.when(role == "user", as_user).otherwise(role), F.lit("\n"))
    rendered = F.concat(head, "text", F.lit(f"{END}\n"))
    end, trained = F.col("char_start") + F.length(rendered), role == "assistant"
    return out.select(
        "conv_id",
        "perspective",
        "seq",
        "turn",
        role.alias("role"),
        F.when(role == "user", name).alias("name"),
        rendered.alias("rendered"),
        "char_start",
        end.alias("char_end"),
        F.when(trained, F.col("char_start") + F.length(head)).alias("mask_start"),
        F.when(trained, end - 1).alias("mask_end"),
    )


def oracle() -> str:
    """perspectives(conversations) in DuckDB's SQL."""
    return f"""
    WITH r AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
    w AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM r WHERE speaker <> 'system'),
    s AS (SELECT r.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role,
                 regexp_replace(speaker, '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g') AS called FROM r JOIN w ON conv_id IS NOT DISTINCT FROM c),
    h AS (SELECT *, '{START}' || role || CASE WHEN role = 'user' THEN ' name=' || called ELSE '' END || chr(10) AS head FROM s),
    t AS (SELECT *, head || text || '{END}' || chr(10) AS rendered FROM h),
    o AS (SELECT *, row_number() OVER w AS seq, coalesce(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM t
          WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text))
    SELECT conv_id, perspective, seq, turn, role, CASE WHEN role = 'user' THEN called END AS name, rendered, char_start, char_start + length(rendered) AS char_end,
           CASE WHEN role = 'assistant' THEN char_start + length(head) END AS mask_start, CASE WHEN role = 'assistant' THEN char_start + length(rendered) - 1 END AS mask_end FROM o"""
