"""PII (9): base detectors and bootstrapped contextual extraction.

1. Base spans: emails, IP addresses, cards and phones by their fixed form.
2. Bootstrapping: every base span is a seed. Seeds and all other
   identifier-like tokens (with a digit or ``@``) are instances; the words
   around an occurrence induce lexical patterns. Spark scores the graph of
   patterns and instances in rounds: a pattern's confidence for a kind is the
   weight of its known instances of that kind over all its instances; an
   unknown instance that a high-confidence pattern vouches for, in front of it or
   behind, becomes known and counts in the next round. Where patterns of several
   kinds vouch, the kind with the highest joint score holds.
3. Occurrences of instances found this way are added to the base spans of
   their text, unless they touch one.

An unknown instance is a run of ``[A-Za-z0-9._%+@-]`` with a digit or ``@`` and
six characters or more, or several runs of digits with one space or bracket
between them (``(555) 123-4567``) and six digits or more in all, or an IBAN in
blocks of four. A run of six characters inside a joined one also counts where
it is known from elsewhere, but induces no patterns of its own there.

All counts cover the whole corpus, distinct pairs of pattern and instance.
Found spans are kept per distinct text (its hash), so copies cost nothing, and
are joined to the documents from a written table: Spark broadcasts it when it
is below the threshold, else shuffles and splits skewed keys.

Defined cases: null text counts as empty and has no spans; null and repeated
doc_ids are kept row by row; very long texts are read whole, in linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, in_steps, materialise, release_memory, small_batches, tidy

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, CONFIDENCE = 3, 5, 0.8

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]+")
_NAME = _LOCAL | {"@"}
_GROUP = re.compile(r"[0-9.+-]+")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[\x20-][A-Z0-9]{4}){2,7}(?:[\x20-](?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_GAPS = (" ", "(", ")", ") ", " (", ")(")  # dots and hyphens are part of a run
_WORDS = re.compile(r"[^\W\d]+|\d+|[^\w\s]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with the longest local part in front of it, from the last match on."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four numbers at a time from every chain of numbers with single dots between."""
    for chain in _DOTTED.finditer(text):
        at, four = chain.start(), []
        for part in chain.group().split("."):
            four = [*four, part] if part else []
            at += len(part) + 1
            if len(four) == 4:
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    yield at - sum(map(len, four)) - 4, at - 1
                four = []


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind, then start; kinds count as in KINDS."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if _HIT.search(text):
        out += [(k, *s) for k, find in ((1, addresses), (2, cards), (3, phones)) for s in find(text)]
    return out


def untouched(found: Iterable[tuple[int, int]], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The places that touch none of the taken ones; both in order."""
    i = 0
    for start, end in found:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if not any(s < end for s, _ in taken[i : i + 1]):
            yield start, end


def runs(text: str) -> Iterator[tuple[int, int]]:
    """Runs of identifier characters with a digit or @."""
    done = 0
    for hit in _HIT.finditer(text):
        if hit.start() < done:
            continue
        start, end = hit.span()
        while start > done and text[start - 1] in _NAME:
            start -= 1
        while end < len(text) and text[end] in _NAME:
            end += 1
        done = end
        while end > start and text[end - 1] in ".-":
            end -= 1
        yield start, end


def joined(text: str, found: Iterable[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The runs, those of one identifier written in groups of digits together."""
    group: list[tuple[int, int]] = []
    digits = False
    for start, end in found:
        now = _GROUP.fullmatch(text, start, end) is not None
        if group and not (digits and now and text[group[-1][1] : min(start, group[-1][1] + 3)] in _GAPS):
            yield group
            group = []
        group.append((start, end))
        digits = now
    if group:
        yield group


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Identifier-like tokens that touch no base span."""
    taken = sorted((s, e) for _, s, e in spans)
    blocks = list(untouched((m.span() for m in _IBAN.finditer(text)), taken))
    yield from blocks
    for group in joined(text, untouched(runs(text), sorted(taken + blocks))):
        start, end = group[0][0], group[-1][1]
        if all(e - s < 6 for s, e in group) and sum(c.isdigit() for c in text[start:end]) < 6:
            continue
        if start and text[start - 1] == "(" and (")" in text[start:end].split("(")[0] or text[end : end + 1] == ")"):
            start -= 1
        if text[end : end + 1] == ")" and "(" in text[start:end].rpartition(")")[2]:
            end += 1
        yield start, end


def inner(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of six characters or more inside a candidate, but not the whole of it."""
    for s, e in runs(text[start:end]):
        if 6 <= e - s < end - start:
            yield start + s, start + e


def context(text: str, at: int, n: int, behind: bool) -> list[str]:
    """The n tokens in front of a place or behind it, whole however long; digits count alike, ``<s>`` is the text's border."""
    size, ended, found = 48, False, []
    while not ended and len(found) <= n:  # one token more than needed: the outermost may be cut
        ended = size >= (len(text) - at if behind else at)
        found = _WORDS.findall(text[at : at + size] if behind else text[max(0, at - size) : at])
        size *= 4
    words = ["#" if t.isdigit() else instance_name(t.lower()) for t in (found[:n] if behind else found[-n:])]
    border = ["<s>"] * (len(words) < n)
    return words + border if behind else border + words


def patterns(text: str, start: int, end: int) -> list[str]:
    """Two and three tokens in front of the place, and behind it; a pattern holds a word, as symbols and numbers alone are layout."""
    left, right = context(text, start, 3, False), context(text, end, 3, True)
    worded = [[any(map(str.isalpha, t)) and t != "<s>" for t in side] for side in (left, right)]
    out = [f"{' '.join(left[-n:])} _" for n in (2, 3) if len(left) >= n and any(worded[0][-n:])]
    return out + [f"_ {' '.join(right[:n])}" for n in (2, 3) if len(right) >= n and any(worded[1][:n])]


def instance_name(text: str) -> str:
    return text if len(text) <= 64 else hashlib.md5(text.encode()).hexdigest()


OCCURRENCE = "text_key binary, start int, end int, instance string, seed int, patterns array<string>"


def occurrences(docs: DataFrame) -> DataFrame:
    """Seeds and candidates of all texts with their patterns; written once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("text_key", pa.binary()), ("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.int32()), ("patterns", pa.list_(pa.string()))])
        for batch in in_steps(batches, 0):
            rows = []
            for raw in as_bytes(batch.column(0)):
                text = raw.decode()
                if not _HIT.search(text):
                    continue
                key, spans = hashlib.md5(raw).digest(), base_spans(text)
                for kind, a, b in spans:
                    rows.append((key, a, b, instance_name(text[a:b]), kind, patterns(text, a, b)))
                for a, b in candidates(text, spans):
                    rows.append((key, a, b, instance_name(text[a:b]), -1, patterns(text, a, b)))
                    rows += [(key, s, e, instance_name(text[s:e]), -1, []) for s, e in inner(text, a, b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return materialise(docs.select("text").mapInArrow(tidy(find), OCCURRENCE), "pii-occurrences")


def discover(found: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """instance, kind: unknown instances that high-confidence patterns vouch for."""
    edges = materialise(found.select(F.explode("patterns").alias("pattern"), "instance", "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-edges")
    known = None
    for _ in range(rounds):
        labelled = edges.withColumn("label", F.when(F.col("seed") >= 0, F.col("seed"))).withColumn("weight", F.when(F.col("seed") >= 0, 1.0))
        if known is not None:
            labelled = edges.join(known.withColumnRenamed("kind", "new"), "instance", "left").select(
                "pattern", "instance", "seed", F.when(F.col("seed") >= 0, F.col("seed")).otherwise(F.col("new")).alias("label"), F.when(F.col("seed") >= 0, 1.0).otherwise(F.col("score")).alias("weight")
            )
        kinds = [F.sum(F.when(F.col("label") == k, F.col("weight"))).alias(f"w{k}") for k in range(len(KINDS))]
        scored = labelled.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("seed") >= 0).cast("long")).alias("seeds"), *kinds)
        top = F.array_max(F.array(*[F.struct(F.coalesce(f"w{k}", F.lit(0.0)).alias("w"), F.lit(k).alias("kind")) for k in range(len(KINDS))]))
        good = scored.withColumn("top", top).select("pattern", "seeds", F.col("top.kind").alias("kind"), (F.col("top.w") / F.col("n")).alias("confidence"))
        trusted = materialise(good.where((F.col("seeds") >= support) & (F.col("confidence") >= confidence)), "pii-patterns")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        vouched = edges.where("seed < 0").join(trusted, "pattern").groupBy("instance", "kind").agg((1 - doubt).alias("score"))
        best = vouched.groupBy("instance").agg(F.max_by(F.struct("kind", "score"), F.struct("score", -F.col("kind"))).alias("b"))
        known = materialise(best.where(F.col("b.score") >= confidence).select("instance", "b.kind", "b.score"), "pii-known")
    return known.select("instance", "kind")


def added_spans(docs: DataFrame) -> DataFrame:
    """text_key and the spans that the method adds to that text."""
    found = occurrences(docs)
    known = discover(found)
    hits = found.where("seed < 0").join(known, "instance").groupBy("text_key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    return materialise(hits, "pii-added")


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def spans_of(text: str, added: list[dict] | None) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of the base spans and the added ones, in that order."""
    spans, end = [(k, s, e, True) for k, s, e in base_spans(text)], 0
    for x in sorted(added or (), key=lambda x: (x["start"], -x["end"])):
        if x["end"] > end:  # not inside one that is there already
            spans.append((x["kind"], x["start"], x["end"], False))
            end = x["end"]
    return sorted(spans)


@F.arrow_udf(SPANS)
def all_spans(text: pa.Array, added: pa.Array) -> pa.Array:
    out = []
    for raw, more in zip(as_bytes(text), added.to_pylist()):
        out.append([dict(zip(("kind", "start", "end", "base"), s)) for s in spans_of(raw.decode(), more)])
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    release_memory()
    return pa.array(out, kind)


def with_added(docs: DataFrame, added: str) -> DataFrame:
    """The documents with the spans that the method adds to their texts."""
    small_batches(docs.sparkSession)
    (key,) = fresh(docs, "text_key")
    more = added_spans(docs).withColumnsRenamed({"text_key": key, "added": added})
    keyed = docs.withColumn(key, F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    keyed = keyed.withColumn(key, F.unhex(key))
    return keyed.join(more, key, "left").select(*docs.columns, added)


def find_spans(docs: DataFrame, column: str = "spans") -> DataFrame:
    """The documents with all their spans (offsets in code points, end exclusive)."""
    (added,) = fresh(docs, "added")
    return with_added(docs, added).withColumn(column, all_spans("text", added)).select(*docs.columns, column)


def masked(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    parts, done = [], 0
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if end <= done:
            continue
        if start >= done:
            parts += [text[done:start], f"<{KINDS[kind].upper()}>"]
        done = end
    return "".join(parts) + text[done:]


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("hit", T.BooleanType())]))
def redacted(text: pa.Array, added: pa.Array) -> pa.Array:
    """The text with its spans masked, and whether it has any."""
    out, hits = [], []
    for value, more in zip(text.to_pylist(), added.to_pylist()):
        spans = spans_of(value or "", more)
        out.append(masked(value, spans) if spans else value)
        hits.append(bool(spans))
    release_memory()
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(hits, pa.bool_())], ["text", "hit"])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by the name of its kind."""
    added, done = fresh(docs, "added", "redacted")
    # spans and masks in one Python step: no copy of the texts is written
    out = with_added(docs, added).withColumn(done, redacted("text", added)).withColumn("text", F.col(done)["text"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(done)["hit"], F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def span_digest(docs: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = find_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: int):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{KINDS[kind]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
