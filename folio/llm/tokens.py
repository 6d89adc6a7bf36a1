"""Token counts behind a cache of digests: no text is encoded twice."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.names import column, sliced
from folio.runtime import Scratch

#: Characters after which a long text is cut, characters encoded at once, and pieces of texts that a task remembers.
PART, AT_ONCE, PIECES = 1 << 15, 1 << 17, 400_000
#: Characters of which no version of Unicode has another opinion, and the letters, digits and white space among them.
SETTLED = re.compile(r"[\t\n\r\x20-\x7e\u00a1-\u024f]*")
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", r"\t\n\r "
#: How byte-level vocabularies cut texts, for settled characters.
RULE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
#: A space after a letter or digit begins a piece of its own in byte-level vocabularies.
BORDER = re.compile(r"(?<=\w) ")
STORED = "digest binary, n_tokens long"


class Counter:
    """Counts a text's tokens with a vocabulary file of the tokenizers library.

    Special strings in a text count as the library's default has it; nothing is
    added, cut off or padded. Long texts are encoded in parts where the file's
    splitting rule can't tell, so a task holds few tokens at a time; with other
    rules a text is encoded as a whole.

    Byte-level vocabularies cut a text into pieces before anything else, and most
    pieces come again and again. So of texts of settled characters without special
    strings the pieces are looked up, and the library encodes those that the task
    hasn't met; all other texts it encodes itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.of.no_truncation()
        self.of.no_padding()
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.splits = splits_at_spaces(config)
        self.special = [x["content"] for x in config.get("added_tokens") or []]
        self.known: dict[str, int] = {}

    def parts(self, text: str) -> Iterator[str]:
        at = 0
        while self.splits and len(text) - at > PART and (m := BORDER.search(text, at + PART)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def counts(self, texts: Iterable[str]) -> list[int]:
        out: list[int] = []
        held: list[tuple[int, str]] = []
        size = 0
        for k, text in enumerate(texts):
            out.append(0)
            for part in self.parts(text):
                held.append((k, part))
                size += len(part)
                if size >= AT_ONCE:
                    self._add(held, out)
                    held, size = [], 0
        self._add(held, out)
        return out

    def _add(self, held: list[tuple[int, str]], out: list[int]) -> None:
        easy = [(k, RULE.findall(x)) for k, x in held if self.settled(x)]
        new = list({p for _, of in easy for p in of if p not in self.known})
        if len(self.known) + len(new) > PIECES:
            self.known.clear()
            new = list({p for _, of in easy for p in of})
        self.known.update(zip(new, self.encoded(new), strict=True))
        for k, of in easy:
            out[k] += sum(map(self.known.__getitem__, of))
        rest = [(k, x) for k, x in held if not self.settled(x)]
        for (k, _), n in zip(rest, self.encoded([x for _, x in rest]), strict=True):
            out[k] += n

    def settled(self, text: str) -> bool:
        return self.splits and bool(SETTLED.fullmatch(text)) and not any(x in text for x in self.special)

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.of.encode_batch_fast(texts, add_special_tokens=False)]


def splits_at_spaces(config: dict) -> bool:
    """Whether no token of this vocabulary file reaches over a space that follows
    a letter or digit, and what stands before it doesn't change what comes after."""
    pre, added = config.get("pre_tokenizer") or {}, config.get("added_tokens") or []
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    return plain and not config.get("normalizer") and not config.get("post_processor") and not any(" " in x["content"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in added)


def version(path: str, note: str = "") -> str:
    """Digest of what a count depends on besides the text: the vocabulary file, the
    library's version, and a note on how texts are normalised."""
    import tokenizers

    h = hashlib.sha256(f"tokenizers {tokenizers.__version__}\nnothing added, default specials\n{note}\n".encode())
    with open(path, "rb") as f:
        h.update(f.read())
    return h.hexdigest()


_counters: dict[tuple[str, str], Counter] = {}


def _counter(path: str, made: str) -> Counter:
    if (path, made) not in _counters:
        _counters.clear()
        _counters[path, made] = Counter(path)
    return _counters[path, made]


def encoded(texts: DataFrame, path: str, made: str) -> DataFrame:
    """(digest, text) to (digest, n_tokens), each digest of a task once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = _counter(path, made), set()
        for part in sliced(batches, 250):
            new = {d: k for k, d in enumerate(part.column(0).to_pylist()) if d not in seen}
            seen.update(new)
            take = part.column(1).take(pa.array(list(new.values()), pa.int64())).to_pylist()
            n = counter.counts(t.decode("utf-8", "replace") for t in take)
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return texts.mapInArrow(run, STORED)


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The counts in a cache, one row a digest; None where there are none yet.

    Jobs that ran side by side may have stored a digest twice, with one count."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    found = spark.read.schema(STORED).option("recursiveFileLookup", True).parquet(folder)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, normalise: Callable[[Column], Column] | None = None, note: str = "") -> DataFrame:
    """id, n_bytes, n_tokens and over_limit (more tokens than ``limit``) of each row.

    ``cache`` is a folder that all jobs share. It has a folder for each tokenizer
    version() with the SHA-256 of contents and their counts. Digests of docs are
    joined to it; of those without a count one row each is encoded and appended,
    every job's in a folder of its own, so that jobs side by side or stopped ones
    leave nothing half written that is read. Without ``cache`` a new, empty one
    serves this call alone.

    ``normalise`` makes equal what the vocabulary can't tell apart, so that such
    texts share a count; it must not change any count, and ``note`` names it in
    the version. Without it contents are the texts' bytes. n_bytes is always that
    of the text as it is. Null texts are empty ones and have no tokens. Rows that
    repeat come back repeatedly; a null id is like any other. Bytes that aren't
    UTF-8 count as U+FFFD. Other columns aren't read; an empty table gives an
    empty result.

    The rows' digests are grouped before anything else, so copies don't meet in a
    task; texts move once, and only those of misses if there are few of them.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    made = version(path, note)
    text = F.coalesce(column(text_col).cast("string"), F.lit(""))
    content = normalise(text) if normalise else text
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    prints = scratch.save(docs.select(column(id_col).alias("id"), digest.alias("digest"), F.octet_length(text).cast("long").alias("n_bytes")), "prints")
    # a row of each content stands for it
    wanted = prints.groupBy("digest").agg(F.min("id").alias("id"))
    before = stored(spark, f"{cache}/{made}") if cache else None
    known = wanted.withColumn("n_tokens", F.lit(None).cast("long")) if before is None else wanted.join(before, "digest", "left")
    known = scratch.save(known, "known")
    misses = known.where("n_tokens is null").select(F.col("digest").alias("_digest"), F.col("id").alias("_id"))
    texts = docs.select(column(id_col).alias("id"), digest.alias("digest"), content.cast("binary").alias("text"))
    texts = texts.join(misses, F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("digest", "text")
    new = encoded(texts, path, made).dropDuplicates(["digest"])
    if cache:
        folder = f"{cache}/{made}/{uuid.uuid4().hex}"
        new.write.parquet(folder)
        new = spark.read.schema(STORED).parquet(folder)
    else:
        new = scratch.save(new, "new")
    counts = known.where("n_tokens is not null").select("digest", "n_tokens").unionByName(new)
    out = prints.join(counts, "digest")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
