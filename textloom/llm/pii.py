"""Personal data by bootstrapped contextual extraction.

Fixed patterns give the seed entities (e-mail, IP, card, phone).  Around an entity stand its
lexical patterns: the word before, the two words before, the word after, the words on both
sides; and its shape, with digits counted and letters not, is one more.  Other strings that look
like identifiers are candidate instances: tokens with a digit or an "@", and up to four
neighbouring tokens of digits and telephone marks.  Numbers that fail a card's or address's check are
counter-examples.  Each is tied to the patterns it stands in, and equal strings are one instance
across the corpus.

Spark scores this graph in rounds.  A pattern belongs to the kind of most of its seeds; its
confidence is their number, by that of its seeds, counter-examples and seeds of other kinds, and
a tenth of its unseen instances.  Candidates of a pattern that passes the threshold, and those
that equal a seed, are accepted: they are seeds of their patterns in the next round, and spans
of the pattern's kind wherever they occur.  Rounds end when nothing new is accepted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import drop_written, narrowed, read_table, written
from textloom.llm.registry import register

KINDS = ("email", "ip", "card", "phone")
MIN_CONFIDENCE = 0.9   # of a pattern, for its unseen instances to be accepted
UNSEEN_WEIGHT = 0.1    # of a counter-example's, that an unseen instance has
MIN_LENGTH = 6         # characters of a candidate
MIN_SEEDS = (5, 3, 5, 3, 5)  # distinct seeds that a pattern needs: word before, two before, word after, both sides, shape
NUMBER_TOKENS = 4      # tokens of a candidate that is a written-out number

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]")
_NUMBER = re.compile(r"[+().0-9-]*[0-9][+().0-9-]*")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE = frozenset(" \t\n\x0b\x0c\r")
_STRIP = ".,;:!?\"'()[]{}<>"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    # every match holds exactly one "@", so going from one to the next finds the leftmost matches
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every seed entity, sorted; code points, end exclusive."""
    return checked_spans(text)[0]


def checked_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """The seed entities, and (start, end) of addresses and card-like numbers that fail their check."""
    failed = []
    out = [(s, 0, e) for s, e in _emails(text)] if "@" in text else []
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                out.append((m.start(), 1, m.end()))
            else:
                failed.append((m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                if _luhn(digits):
                    out.append((m.start(), 2, m.end()))
                else:
                    failed.append((m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out), failed


def _word_before(text: str, at: int) -> tuple[int, int]:
    """(start, end) of the token that ends before `at`; equal if there is none."""
    while at and text[at - 1] in _SPACE:
        at -= 1
    start = at
    while start and text[start - 1] not in _SPACE:
        start -= 1
    return start, at


def _word(text: str, start: int, end: int) -> str:
    return text[start:end].strip(_STRIP).lower()


def shape(instance: str) -> str:
    """Digits as 9, runs of letters as a, other marks as they are; L marks a card number that passes its check."""
    digits = instance.replace(" ", "").replace("-", "")
    valid = 12 <= len(digits) <= 19 and digits.isascii() and digits.isdigit() and _luhn(digits)
    return re.sub("[0-9]", "9", _LETTERS.sub("a", instance)) + "L" * valid


def patterns_of(text: str, start: int, end: int) -> list[str | None]:
    """The word before a string, the two before, the word after, both sides, and its shape; None where a word is missing."""
    s1, e1 = _word_before(text, start)
    s2, e2 = _word_before(text, s1)
    m = _TOKEN.search(text, end)
    if m and m.start() == end:  # marks that touch the string are no word
        m = _TOKEN.search(text, m.end())
    after = _word(text, *m.span()) if m else ""
    before, second = _word(text, s1, e1), _word(text, s2, e2)
    return [before or None, f"{second} {before}" if before and second else None, after or None,
            f"{before} {after}" if before and after else None, shape(text[start:end])]


def _numbers(tokens: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """(start, end) of up to `NUMBER_TOKENS` of the tokens, two at least."""
    for i in range(len(tokens)):
        for j in range(i + 1, min(i + NUMBER_TOKENS, len(tokens))):
            yield tokens[i][0], tokens[j][1]


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, list[str | None], str]]]:
    """The base spans, and (start, end, kind, patterns, instance) of seeds, counter-examples and
    candidates.  Kind is the seed's, or -2 for what fails its kind's check, or -1 for strings that no
    fixed pattern covers."""
    base, failed = checked_spans(text)
    found = [(s, e, k) for s, k, e in base]
    taken = sorted([(s, e, True) for s, _, e in base] + [(s, e, False) for s, e in failed])
    at = end = 0

    def kind(start: int, end: int) -> int | None:
        """Of a candidate: None if it meets a base span, -2 if it meets a failed number."""
        nonlocal at
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        hit, j = None, at
        while j < len(taken) and taken[j][0] < end:
            if taken[j][1] > start:
                if taken[j][2]:
                    return None
                hit = -2
            j += 1
        return hit or -1

    chain: list[tuple[int, int, int]] = []  # neighbouring number tokens: start, end without marks, end
    free: list[tuple[int, int]] = []
    while mark := _MARK.search(text, end):
        start, begin = mark.start(), end
        while start > begin and text[start - 1] not in _SPACE:
            start -= 1
        end = _TOKEN.match(text, start).end()
        token = text[start:end]
        left, right = end - len(token.lstrip(_STRIP)), start + len(token.rstrip(_STRIP))
        if left >= right:
            continue
        what = kind(left, right)
        if what is not None and right - left >= MIN_LENGTH:
            found.append((left, right, what))
        if _NUMBER.fullmatch(token.rstrip(_STRIP.replace("(", "").replace(")", "")) or " ") and what == -1:
            if chain and text[chain[-1][2] : start].strip(" "):
                free += _numbers(chain)
                chain = []
            chain.append((start, start + len(token.rstrip(_STRIP)), end))
        else:
            free += _numbers(chain)
            chain = []
    free += _numbers(chain)
    found += [(s, e, -1) for s, e in free]
    return base, [(s, e, k, patterns_of(text, s, e), text[s:e].lower()) for s, e, k in found]


def find_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, doc_id, base array<struct<start, kind, end>>, found array<struct<start, end, kind, patterns, instance>>);
    patterns and instances as 64-bit hashes, their texts stay in the task."""
    kept = narrowed(docs, id_col, text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    hit = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("patterns", pa.list_(pa.int64())), ("instance", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        number = lambda s, seed=0: xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), seed) - (1 << 63)
        for batch in batches:
            bases, hits = [], []
            for text in batch.column(1).to_pylist():
                base, found = occurrences(text or "")
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                hits.append([{"start": s, "end": e, "kind": k, "patterns": [None if p is None else number(p, n + 1) for n, p in enumerate(ps)],
                              "instance": number(i)} for s, e, k, ps, i in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, pa.list_(span)), pa.array(hits, pa.list_(hit))], ["doc_id", "base", "found"])

    return kept.mapInArrow(run, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, "
                                "found array<struct<start:int,end:int,kind:int,patterns:array<bigint>,instance:bigint>>")


def confident(graph: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: tuple[int, ...] = MIN_SEEDS) -> DataFrame:
    """(pattern, pattern_kind, confidence) of the patterns that pass.  `graph` has form (the number of the
    pattern's form), pattern, instance, kind (-1: candidate, -2: counter-example), each row once.
    If kinds tie, a pattern belongs to the first listed."""
    per = graph.groupBy("form", "pattern").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("kind") == -1, 1)).alias("unseen"),
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in range(len(KINDS))])
    seeds = F.greatest(*[F.col(f"k{k}") for k in range(len(KINDS))])
    kind = F.coalesce(*[F.when(F.col(f"k{k}") == seeds, F.lit(k)) for k in range(len(KINDS))])
    need = F.get(F.array(*[F.lit(n) for n in min_seeds]), F.col("form"))
    confidence = seeds / (F.col("n") - (1 - UNSEEN_WEIGHT) * F.col("unseen"))
    return per.where(seeds >= need).select("pattern", kind.alias("pattern_kind"), confidence.alias("confidence")).where(F.col("confidence") >= min_confidence)


def proven(edges: DataFrame, min_confidence: float = MIN_CONFIDENCE, min_seeds: tuple[int, ...] = MIN_SEEDS) -> DataFrame:
    """(instance, new_kind): every candidate that is accepted; its kind is that of its surest
    pattern (the first listed if they tie).  `edges` as in `confident`."""
    open_ = edges.where("kind = -1")
    # only patterns with candidates can accept any, and their seeds and counter-examples say whether they do
    graph = written(edges.join(open_.select("pattern").distinct(), "pattern", "left_semi"), "pii-graph")
    seeds = edges.where("kind >= 0").select("instance", "kind").distinct()
    found = new = written(open_.select("instance").distinct().join(seeds, "instance").groupBy("instance").agg(F.min("kind").alias("new_kind")), "pii-found")
    while True:
        kind = F.when(F.col("kind") == -1, F.coalesce("new_kind", "kind")).otherwise(F.col("kind"))
        before = graph
        graph = written(graph.join(new, "instance", "left").select("form", "pattern", "instance", kind.alias("kind")).distinct(), "pii-graph")
        drop_written(before)
        best = F.max(F.struct("confidence", (-F.col("pattern_kind")).alias("less")))
        sure = confident(graph, min_confidence, min_seeds)
        new = written(graph.where("kind = -1").join(sure, "pattern").groupBy("instance").agg(best.alias("best")).select(
            "instance", (-F.col("best.less")).alias("new_kind")), "pii-found")
        if new.isEmpty():
            drop_written(graph), drop_written(new)
            return found
        found = found.unionByName(new)


def _apart(spans: Column) -> Column:
    """Of overlapping spans the longest, of equally long ones the first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("less"), s["start"], s["kind"], s["end"])))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.array_sort(F.aggregate(order, none, lambda kept, s: F.when(
        F.exists(kept, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"])), kept).otherwise(
        F.concat(kept, F.array(F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  min_confidence: float = MIN_CONFIDENCE, min_seeds: tuple[int, ...] = MIN_SEEDS) -> DataFrame:
    """One row per row of `docs`: doc_id, base and added, both array<struct<start, kind, end>>
    sorted by start, then kind; an added span overlaps no base span and no other added one.

    A null text is empty and has no spans; repeated rows each get theirs (and count once in the
    graph); ids may be null; an empty table gives no rows; other columns are ignored."""
    rows = written(find_occurrences(docs, id_col, text_col), "pii-rows")
    hits = rows.select(F.explode("found").alias("h")).select("h.kind", "h.instance", F.posexplode("h.patterns").alias("form", "pattern"))
    edges = written(hits.where(F.col("pattern").isNotNull()).select("form", "pattern", "instance", "kind").distinct(), "pii-edges")
    good = proven(edges, min_confidence, min_seeds)
    # only documents with candidates go through the join; they come back by a key made of what they hold
    key = F.xxhash64("doc_id", "found")
    open_ = F.array_distinct(F.transform(F.filter("found", lambda h: h["kind"] == -1), lambda h: F.struct(h["start"], h["end"], h["instance"])))
    asked = rows.where(F.exists("found", lambda h: h["kind"] == -1)).select(F.col("doc_id").alias("id"), key.alias("row"), F.explode(open_).alias("h")).distinct()
    added = asked.select("id", "row", "h.*").join(good, "instance").groupBy("id", "row").agg(
        F.collect_list(F.struct("start", F.col("new_kind").alias("kind"), "end")).alias("added"))
    joined = rows.join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (key == F.col("row")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return joined.select("doc_id", F.array_sort("base").alias("base"), F.coalesce(_apart(F.col("added")), none).alias("added"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op3_pii_bootstrap")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(read_table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return got.select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                      F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
                      spans_text(F.concat("base", "added")).alias("spans"))
