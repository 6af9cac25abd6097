"""Personal data: fixed forms, and further identifiers found by bootstrapped context patterns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shotweave.llm.dedup_exact import fresh, split_by_ids
from shotweave.llm.flat import pieces
from shotweave.llm.registry import query, table
from shotweave.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
ROUNDS = 3
MIN_SEEDS = 3
MIN_CONFIDENCE = 0.8
CONTEXT_CHARS = 48

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed forms, per kind leftmost and without overlap; offsets in code points."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL_CHARS:
            left -= 1
        right = _DOMAIN.match(text, at + 1) if left < at else None
        if right:
            out.append(("email", left, right.end()))
            free = right.end()
        at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Tokens that look like identifiers: at least six characters, three of them digits, and not part of a known span."""
    out, free = [], 0
    known = sorted((a, b) for _, a, b in taken)
    k = 0
    for m in _DIGITS.finditer(text):
        if m.start() < free:
            continue
        start = m.start()
        while start > free and not _BLANK.match(text[start - 1]):
            start -= 1
        stop = _BLANK.search(text, m.end())
        end = free = stop.start() if stop else len(text)
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while k < len(known) and known[k][1] <= start:
            k += 1
        if k < len(known) and known[k][0] < end:
            continue
        if end - start >= 6 and len(_NOT_DIGIT.sub("", text[start:end])) >= 3:
            out.append((start, end))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of an occurrence: the word before, the two words before, the words around, and a key inside the token."""
    before = text[max(0, start - CONTEXT_CHARS):start].lower().split()
    after = text[end:end + CONTEXT_CHARS].lower().split()
    out = []
    if before:
        out.append(f"1 {before[-1]}")
        if len(before) > 1:
            out.append(f"2 {before[-2]} {before[-1]}")
        if after:
            out.append(f"a {before[-1]} _ {after[0]}")
    key = re.match(r"[A-Za-z_-]{3,24}[=:]", text[start:start + 25])
    if key:
        out.append(f"k {key.group().lower()}")
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: ``doc_id, base array<(kind, start, end)>, seen array<(start, end, seed, instance, patterns)>``,
    the fixed forms and all occurrences of seeds and identifier-like tokens with their patterns. Instances are 64-bit digests."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    seen_type = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("instance", pa.int64()),
                           ("patterns", pa.list_(pa.string()))])

    def digest(s: str) -> int:
        return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            base, seen = [], []
            for text in piece.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
                seen.append([
                    {"start": a, "end": b, "seed": seed, "instance": digest(text[a:b]), "patterns": patterns(text, a, b)}
                    for seed, a, b in [*((True, a, b) for _, a, b in spans),
                                       *((False, a, b) for a, b in candidates(text, spans))]
                ])
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(base, pa.list_(span)),
                                              pa.array(seen, pa.list_(seen_type))], names=["doc_id", "base", "seen"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, base array<struct<kind string, start int, end int>>, seen array<struct<"
                                  "start int, end int, seed boolean, instance long, patterns array<string>>>")


def discover(scanned: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS,
             min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``instance`` of every identifier found by bootstrapping.

    The graph has an edge for each distinct (pattern, instance). Seeds have score 1. In every round a pattern's confidence is
    the sum of its instances' scores over their number plus one, so a pattern that also stands before other tokens is weak;
    patterns with at least ``min_seeds`` of score and ``min_confidence`` give their confidence to their instances, which combine
    it as independent evidence. Sums over patterns and instances are pre-aggregated; frequent patterns split in the joins.
    """
    rows = scanned.select(F.explode("seen").alias("s")).select("s.instance", "s.seed", F.explode("s.patterns").alias("text"))
    edges = rows.groupBy(F.xxhash64("text").alias("pattern"), "instance").agg(F.max("seed").alias("seed"))
    edges = cut_lineage(edges)
    scores = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("score"))
    for _ in range(rounds):
        scored = edges.join(scores, "instance")
        confidence = scored.groupBy("pattern").agg(F.sum("score").alias("mass"), F.count(F.lit(1)).alias("n"))
        strong = confidence.select("pattern", "mass", (F.col("mass") / (F.col("n") + 1)).alias("c")).filter(
            (F.col("mass") >= min_seeds) & (F.col("c") >= min_confidence)).select("pattern", "c")
        evidence = edges.join(strong, "pattern").groupBy("instance").agg(
            (1 - F.exp(F.sum(F.log(1 - F.col("c"))))).alias("new"))
        scores = cut_lineage(scores.join(evidence, "instance", "left").select(
            "instance", F.greatest("score", F.coalesce("new", F.lit(0.0))).alias("score")))
    seeds = edges.filter("seed").select("instance").distinct()
    return scores.filter(F.col("score") >= min_confidence).select("instance").join(seeds, "instance", "left_anti")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, found`` for every row: arrays of (kind, start, end); ``found`` holds what the patterns add, of kind ``id``.

    A null text is empty and has no spans. Rows that repeat an id get the spans of all its rows' added occurrences only if their
    texts agree (ids are expected to be unique). Other columns are ignored; an empty table gives an empty result.
    The texts are read once and never shuffle; the narrow scan goes to the checkpoint folder.
    """
    scanned = cut_lineage(scan(docs, id_col, text_col))
    new = discover(scanned)
    occurrences = scanned.select("doc_id", F.explode("seen").alias("s")).filter("not s.seed").select(
        "doc_id", "s.start", "s.end", "s.instance")
    found = occurrences.join(new, "instance").groupBy("doc_id").agg(F.array_sort(F.collect_set(
        F.struct(F.lit(FOUND).alias("kind"), "start", "end"))).alias("found"))
    empty = F.array().cast("array<struct<kind string, start int, end int>>")
    return scanned.select("doc_id", "base").join(found, "doc_id", "left").select(
        "doc_id", "base", F.coalesce("found", empty).alias("found"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"),
                                                                 s["end"].cast("string"))), ",")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (``[email]``); overlapping spans become one, named by the first.
    All columns stay, a null text stays null. Only texts with added spans shuffle; the fixed forms are replaced where they are read."""
    scanned = cut_lineage(scan(docs, id_col, text_col))
    new = discover(scanned)
    found_id, found_spans = fresh("_found_id", docs.columns), fresh("_found_spans", docs.columns)
    found = cut_lineage(
        scanned.select("doc_id", F.explode("seen").alias("s")).filter("not s.seed")
        .select("doc_id", "s.start", "s.end", "s.instance").join(new, "instance").groupBy("doc_id")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans")).select(
            F.col("doc_id").alias(found_id), F.col("spans").alias(found_spans)))
    docs = docs.withColumn(id_col, F.col(id_col).cast("long"))
    some, none = split_by_ids(docs, found.select(found_id), id_col)
    some = some.join(found, F.col(id_col).eqNullSafe(F.col(found_id)), "left").select(*docs.columns, found_spans)
    none = none.withColumn(found_spans, F.lit(None).cast("array<struct<start int, end int>>"))

    def clean(text: str, extra: list | None) -> str:
        spans = sorted([(a, b, k) for k, a, b in base_spans(text)]
                       + [(s["start"], s["end"], FOUND) for s in extra or [] if s["end"] <= len(text)])
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out += [text[at:a], f"[{kind}]"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            i, j = batch.schema.get_field_index(text_col), batch.schema.get_field_index(found_spans)
            texts = [None if t is None else clean(t, s)
                     for t, s in zip(batch.column(i).to_pylist(), batch.column(j).to_pylist())]
            columns = [pa.array(texts, pa.string()) if k == i else c for k, c in enumerate(batch.columns) if k != j]
            yield pa.RecordBatch.from_arrays(columns, names=[n for k, n in enumerate(batch.schema.names) if k != j])

    return some.unionByName(none).mapInArrow(run, docs.schema)


@query()
def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    spans = find_spans(table(spark, folder, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return spans.select("doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                        joined(F.concat("base", "found")).alias("spans"))
