"""Personal data by bootstrapped contextual extraction.

Base recognisers (email, ip, card, phone) give exact spans and the seeds. Every seed and every other
identifier-like token of the corpus (an @, or three digits or more, grouped or not) is an instance;
the words around an occurrence, with the slot's coarse class (address or number), are lexical
patterns. Over the pattern-instance graph Spark alternates: a pattern's confidence in a kind is the
share of its occurrences held by instances believed to be of that kind (with at least ``SUPPORT``
different ones), and an unknown instance's belief is the noisy-or of its confident patterns times a
score of its form (short numbers and years prove less). Its exact form is free: a national phone
number is found in the contexts of international ones. Instances believed after ``ROUNDS`` rounds add
the spans of their occurrences.

Base spans follow the patterns below, leftmost and non-overlapping per kind; a match that fails its
check (range, digit count, Luhn) is dropped without a retry. Scans are linear in the text.

Edge cases: null is the empty text; repeated rows give equal results; null ids are kept; added
spans never overlap a base span; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm.common import keyed, materialize, text_rows

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs this many believed instances and this confidence; an instance this belief.
SUPPORT, CONFIDENCE, BELIEF = 3, 0.7, 0.8
#: Characters around an occurrence in which its context words are sought.
REACH = 80

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_AT = re.compile(r"@|[(\[]at[)\]]", re.IGNORECASE)
_HINT = re.compile(rf"[0-9]|{_AT.pattern}", re.IGNORECASE)
_TOKEN = re.compile(r"[\w.%+@:/()\[\]-]*")
_MARKS = "._%+@:/()[]-"
#: Colon groups of hex digits (IPv6, MAC) stay whole; other tokens end at a colon.
_HEX = re.compile(r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,}")
#: Groups of digits that read as one number.
_NUMBER = re.compile(r"[0-9]{2}(?:[ ][0-9]{2}){3,}(?![0-9])|[0-9]++\)?(?:[ ]?[()./-][ ]?\(?[0-9]{2,}+|[ ]\(?[0-9]{3,}+)*+")
_PLAIN = re.compile(r"[0-9().+/-]+")
_WORD = re.compile(r"\w+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and _LOCAL.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        else:
            end = max(end, at)  # no later match can begin before this sign
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text)
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), by kind as listed, then start; code points, end exclusive."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(1, a, b) for a, b in ips(text)]
        out += [(2, a, b) for a, b in cards(text)]
        if "+" in text:
            out += [(3, a, b) for a, b in phones(text)]
    return out


def context_patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before; one before and one after; with the slot's class."""
    slot = "_@" if _AT.search(text, start, end) else "_9"
    left = _WORD.findall(text[max(0, start - REACH):start].lower())[-2:]
    right = _WORD.search(text[end:end + REACH].lower())
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} {slot}")
    if left and right:
        out.append(f"{left[-1]} {slot} {right[0]}")
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Identifier-like tokens (an @, or at least three digits, grouped or not) outside the base spans."""
    out, end = [], 0
    taken = sorted((a, b) for _, a, b in base)
    k, token_end, cut = 0, -1, False
    at = _HINT.search(text)
    while at:
        hint = start = at.start()
        while start > end and (text[start - 1].isalnum() or text[start - 1] in _MARKS):
            start -= 1
        if hint >= token_end:  # a token is read to its end once; what is left behind its first colon is cut as well
            token_end = _TOKEN.match(text, hint).end()
            cut = text.find(":", start, token_end) >= 0 and not _HEX.fullmatch(text, start, token_end)
        stop = token_end
        if cut:
            start = max(start, text.rfind(":", start, hint) + 1)
            colon = text.find(":", hint, stop)
            stop = colon if colon >= 0 else stop
        end = max(stop, at.end())
        while stop > start and text[stop - 1] in ".-%+:/()[]":
            stop -= 1
        while start < stop and text[start] in ".-%+:/()[]":
            start += 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if _PLAIN.fullmatch(text, start, stop):
            m = _NUMBER.match(text, start, taken[k][0] if k < len(taken) and taken[k][0] > start else len(text))
            if m and m.end() > stop:
                stop = m.end()
                end = max(end, stop)
            if start and text[start - 1] == "(" and text.find(")", start, stop) >= 0:
                start -= 1
        if not any(a < stop and b > start for a, b in taken[k:k + 8]):
            if _AT.search(text, start, stop):
                wide = stop - start >= 5
            else:
                wide = len(_DIGIT.findall(text, start, stop)) >= 3 or (_HEX.fullmatch(text, start, stop) and _DIGIT.search(text, start, stop))
            if wide:
                out.append((start, stop))
        at = _HINT.search(text, end)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_OCC = "array<struct<kind:int,start:int,stop:int,instance:string,patterns:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, txt, counts and digest of base spans, and the occurrences of all instances."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"doc_id {kind}, txt long, " + ", ".join(f"n_{k} long" for k in KINDS)
              + f", base string, base_sha256 string, occurrences {_OCC}")
    item = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("instance", pa.string()),
                      ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, sha, occurrences = [[] for _ in KINDS], [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found = base_spans(text)
                for k, c in enumerate(counts):
                    c.append(sum(1 for x in found if x[0] == k))
                base.append(joined(found))
                sha.append(hashlib.sha256(base[-1].encode()).hexdigest())
                more = [(-1, a, b) for a, b in candidates(text, found)]
                occurrences.append([{"kind": k, "start": a, "stop": b, "instance": text[a:b].lower(),
                                     "patterns": context_patterns(text, a, b)} for k, a, b in found + more])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("txt"), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()),
                 pa.array(sha, pa.string()), pa.array(occurrences, pa.list_(item))],
                names=["doc_id", "txt", *(f"n_{k}" for k in KINDS), "base", "base_sha256", "occurrences"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def form_score(instance: str) -> Column:
    """How far an instance's own form speaks for an identifier: short numbers and years say little."""
    digits = F.length(F.regexp_replace(instance, "[^0-9]", ""))
    return (F.when(F.col(instance).rlike(r"@|[(\[]at[)\]]"), 1.0)
            .when(F.col(instance).rlike("^(19|20)[0-9]{2}$"), 0.82)
            .when(digits <= 3, 0.85).when(digits <= 5, 0.92).otherwise(1.0))


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Believed unknown instances: instance, kind, belief. ``occurrences``: instance, kind (-1 unknown), pattern."""
    edges = materialize(occurrences.groupBy("instance", "pattern").agg(F.count(F.lit(1)).alias("n")), "pii-edges")
    kinds = range(len(KINDS))
    weights = [f"w{k}" for k in kinds]
    seeds = (occurrences.groupBy("instance")
             .agg(*[F.max((F.col("kind") == k).cast("double")).alias(f"w{k}") for k in kinds]))
    seeds = materialize(seeds.where(" + ".join(weights) + " > 0"), "pii-seeds")
    belief = seeds
    for _ in range(rounds):
        held = edges.join(belief, "instance", "left").na.fill(0.0, weights)
        scored = held.groupBy("pattern").agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("n") * F.when(F.col(w) >= BELIEF, F.col(w)).otherwise(0.0)).alias(f"s_{w}") for w in weights],
            *[F.sum((F.col(w) >= BELIEF).cast("int")).alias(f"c_{w}") for w in weights])
        # log(1 - confidence) of the kinds a pattern is confident in
        miss = [F.when((F.col(f"c_{w}") >= SUPPORT) & (F.col(f"s_{w}") >= CONFIDENCE * F.col("n")),
                       F.log(F.greatest(F.lit(1e-3), 1 - F.col(f"s_{w}") / F.col("n")))).otherwise(0.0).alias(f"m_{w}") for w in weights]
        confident = scored.select("pattern", *miss).where(" + ".join(f"m_{w}" for w in weights) + " < 0")
        unknown = (edges.join(confident, "pattern").groupBy("instance")
                   .agg(*[((1 - F.exp(F.sum(f"m_{w}"))) * form_score("instance")).alias(w) for w in weights])
                   .join(seeds.select("instance"), "instance", "left_anti"))
        belief = materialize(seeds.unionByName(unknown), "pii-belief")
    new = belief.join(seeds.select("instance"), "instance", "left_anti")
    best = F.array_max(F.array(*[F.struct(F.col(w).alias("belief"), F.lit(-k).alias("k")) for k, w in enumerate(weights)]))
    return (new.withColumn("best", best).where(F.col("best.belief") >= BELIEF)
            .select("instance", (-F.col("best.k")).alias("kind"), F.col("best.belief").alias("belief")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, txt, n_*, base_sha256, base, spans (all, as text) and ``added`` (kind, start, stop)."""
    rows = materialize(scan(docs, id_col, text_col), "pii-rows")
    single = rows.select("doc_id", "txt", F.explode("occurrences").alias("o")).select("doc_id", "txt", "o.*")
    occurrences = single.select("instance", "kind", F.explode("patterns").alias("pattern"))
    new = materialize(bootstrap(occurrences), "pii-new")
    hits = (single.where("kind < 0").drop("kind").join(new.select("instance", "kind"), "instance")
            .groupBy("doc_id", "txt").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "stop"))).alias("added")))
    hits = materialize(hits, "pii-added").withColumnsRenamed({"doc_id": "h_id", "txt": "h_txt"})
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("txt") == F.col("h_txt")), "left")
    base = F.transform(F.filter("occurrences", lambda o: o["kind"] >= 0),
                       lambda o: F.struct(o["kind"].alias("kind"), o["start"].alias("start"), o["stop"].alias("stop")))
    every = F.array_sort(F.concat(base, F.coalesce(F.col("added"), F.expr("array()").cast("array<struct<kind:int,start:int,stop:int>>"))))
    name = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("every", lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"),
                                                                   s["stop"].cast("string"))), ",")
    return (out.withColumn("every", every).withColumn("spans", spans)
            .select("doc_id", "txt", *[f"n_{k}" for k in KINDS], "base", "base_sha256", "spans", "added"))


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all spans masked; the columns stay as they are. Base spans are found again in place, so only
    the few rows with added spans are joined."""
    hits = found.where("added IS NOT NULL").select(F.xxhash64("doc_id").alias("i"), F.col("txt").alias("t"), "added")
    rows = keyed(docs, id_col, text_col).join(hits.dropDuplicates(["i", "t"]), ["i", "t"], "left")
    rows = rows.select(*[f"c{i}" for i in range(len(docs.columns))], "added")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, added in text_rows(batch, f"c{at}", "added"):
                if text:
                    spans = base_spans(text) + [(s["kind"], s["start"], s["stop"]) for s in added or []]
                    text = mask(text, spans) if spans else text
                texts.append(text)
            columns = [batch.column(i) for i in range(len(batch.schema) - 1)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return rows.mapInArrow(run, schema).toDF(*docs.columns)


def pii_digest(docs: DataFrame) -> DataFrame:
    """The registered query."""
    return find(docs).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans")
