"""Personal data by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts. They are
the seeds. Every mention, and every string that has the shape of one of those kinds without meeting
its pattern (a phone number without its plus, a card number that fails the check sum, an address
without a dot), is an instance that stands in lexical patterns: the two words before it, and the
words on both sides of it. Numbers that stand side by side are one run: what seeds leave of it is cut
at its spaces, a part of too many digits at its other signs too, and each part, and neighbouring parts
together, are readings of the run, one for each kind that their digits allow. Spark scores the graph of patterns and instances in rounds:

* a pattern's confidence in a kind is the weight of its known instances of that kind over that of
  all its distinct instances, where those of unknown standing count `UNKNOWN` each, of the readings of
  one run that share the pattern only the longest; a pattern needs `SUPPORT` known instances;
* an instance of unknown standing becomes known if the patterns it stands in that are confident
  (`CONFIDENT` or more) leave at most 1 - `ACCEPTED` doubt together.

Known instances raise patterns in the next round, and stay known with the belief they were accepted
with; rounds go on until one accepts none, so the result is a fixed point. Then every mention of an instance that
became known, or is a seed elsewhere, is a span; seed spans always stay. Of overlapping readings of
one kind the one with the strongest belief stays, then the longest, then the first. Distinct edges are formed before anything is summed,
so a pattern or an instance that holds a third of all mentions is summed before it is shuffled.

Defined results: a null text is empty; spans of different kinds may overlap; repeated rows have equal
spans, and repeated mentions are one instance. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import packed, settle, text_or_empty

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 4
CONFIDENT, ACCEPTED = 0.8, 0.8
UNKNOWN = 0.25
CONTEXT = 80  # characters on either side that are looked at for words

# The parts of the base patterns.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Shapes of what may be an instance without being a seed.
BARE_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*|(?: ?\[at\] ?)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
BARE_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
PART = re.compile(r"\(?[0-9](?:[().-]{0,2}[0-9])*")
ATOM = re.compile(r"\(?[0-9]+")
LEAST, MOST = 7, 19  # digits of a bare number
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"\w+")

Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _addresses(text: str, domain: re.Pattern) -> Iterator[tuple[int, int]]:
    """Spans of local parts and domains. Each stretch before a sign is looked at once."""
    floor = 0
    for match in domain.finditer(text):
        sign = match.start()
        crossed = text.rfind("@", floor, sign)
        stretch = text[max(floor, crossed + 1):sign]
        start = sign - (len(stretch) - len(stretch.rstrip(LOCAL)))
        if start < sign:
            yield start, match.end()
            floor = match.end()
        else:
            floor = sign + 1


def base_spans(text: str) -> list[Span]:
    """Leftmost spans of each kind that do not overlap within it, by start, then kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(start, 0, end) for start, end in _addresses(text, DOMAIN)]
    if not DIGIT.search(text):
        return found
    for chain in DOTTED.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                found.append((at, 1, end))
            at = end + 1
    for match in CARD.finditer(text):
        if match.end() - match.start() >= 12:
            digits = match.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match.group()) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def _digits(shown: str) -> int:
    return sum(c.isdigit() for c in shown)


def _kinds(shown: str, digits: int) -> tuple[int, ...]:
    """The kinds whose shape a bare number has."""
    if shown.count(".") == 3 and "(" not in shown and " " not in shown:
        return (1,)
    return (3,) * (digits <= 15) + (2,) * (digits >= 12)


def _readings(text: str, start: int, end: int) -> list[Span]:
    """What a stretch of numbers may hold, the longest first."""
    parts = []
    for part in PART.finditer(text, start, end):
        whole = _digits(part.group()) <= MOST
        parts += [(p.start(), p.end(), _digits(p.group())) for p in ([part] if whole else ATOM.finditer(text, *part.span()))]
    found = []
    for k, (low, _, _) in enumerate(parts):
        digits = 0
        for _, high, more in parts[k:k + MOST]:
            digits += more
            if digits > MOST:
                break
            if digits >= LEAST:
                for kind in _kinds(text[low:high], digits):
                    signed = kind == 3 and k == 0 and low == start > 0 and text[low - 1] == "+"
                    found.append((low - signed, kind, high))
    return sorted(found, key=lambda span: (span[0] - span[2], span))


def runs(text: str, seeds: list[Span]) -> Iterator[list[Span]]:
    """Strings with the shape of a kind that touch no seed; the readings of a run are one list."""
    starts = [start for start, _, _ in seeds]
    reach = list(accumulate((end for _, _, end in seeds), max))  # of the seeds up to one
    if "@" in text or "[at]" in text:
        for start, end in _addresses(text, BARE_DOMAIN):
            before = bisect_left(starts, end)
            if not before or reach[before - 1] <= start:
                yield [(start, 0, end)]
    if DIGIT.search(text):
        for match in BARE_NUMBER.finditer(text):
            at, end = match.span()
            found = []
            for k in range(bisect_right(reach, at), bisect_left(starts, end)):
                found += _readings(text, at, starts[k])
                at = max(at, reach[k])
            found += _readings(text, at, end)
            if found:
                yield found


def candidates(text: str, seeds: list[Span]) -> list[Span]:
    """All readings of all runs, by start, then kind."""
    return sorted(span for run in runs(text, seeds) for span in run)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _patterns(text: str, span: Span) -> tuple[int, int]:
    """Hashes of the two words before a span, and of the words on both sides of it."""
    from xxhash import xxh64_intdigest as digest

    left = WORD.findall(text[max(0, span[0] - CONTEXT):span[0]].lower())[-2:]
    right = WORD.search(text[span[2]:span[2] + CONTEXT].lower())
    left = ["^"] * (2 - len(left)) + left
    around = f"{left[1]} _ {right.group() if right else '$'}"
    return tuple(digest(p.encode()) >> 1 for p in (f"{left[0]} {left[1]} _", around))


SCANNED = ("row long, doc_id long, text_hash long, n_email long, n_ip long, n_card long, n_phone long, "
           "base_sha256 string, base array<struct<start int, kind int, end int>>, "
           "mentions array<struct<start int, kind int, end int, seed boolean, instance long, "
           "before struct<pattern long, counts boolean>, around struct<pattern long, counts boolean>>>")


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: its base spans, and all mentions with their patterns."""
    from xxhash import xxh64_intdigest as digest

    def scanned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for doc_id, text, text_hash in zip(batch["doc_id"], batch["text"], batch["text_hash"], strict=True):
                base = base_spans(text)
                counts = [0] * len(KINDS)
                mentions = []
                for span in base:
                    counts[span[1]] += 1
                for seed, spans in (*((True, [span]) for span in base), *((False, run) for run in runs(text, base))):
                    met = set()
                    for span in spans:
                        instance = digest(text[span[0]:span[2]].lower().encode()) >> 1
                        patterns = _patterns(text, span)
                        mentions.append((*span, seed, instance, *((p, p not in met) for p in patterns)))
                        met.update(patterns)
                found.append((row, doc_id, text_hash, *counts, hashlib.sha256(shown(base).encode()).hexdigest(), base, mentions))
                row += 1
            out = pd.DataFrame(found, columns=["row", "doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone",
                                               "base_sha256", "base", "mentions"])
            out["doc_id"] = batch["doc_id"].to_numpy()
            yield out

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return text.withColumn("text_hash", F.xxhash64("text")).mapInPandas(scanned, SCANNED)


def discover(mentions: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT,
             accepted: float = ACCEPTED) -> DataFrame:
    """Instances that are seeds elsewhere or become known from the patterns they stand in: instance, kind, belief.

    An instance may have several kinds. `mentions` has instance, kind, seed, and the patterns before and around, each with whether the
    instance counts there while its standing is unknown.
    """
    stood = mentions.select("instance", "kind", "seed", F.explode(F.array("before", "around")).alias("in")).select(
        "instance", "kind", "seed", "in.*")
    edges = stood.groupBy("pattern", "instance", "kind").agg(F.max("seed").alias("seed"), F.max("counts").alias("counts"))
    edges = settle(edges, "pii-edges")
    elsewhere = mentions.groupBy("instance", "kind").agg(F.max("seed").alias("some"), F.min("seed").alias("all")).where(
        F.col("some") & ~F.col("all")).select("instance", "kind", F.lit(1.0).alias("belief"))
    known = settle(elsewhere, "pii-known")
    size, before = known.count(), -1
    while size != before:
        beliefs = known.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct("kind", "belief"))).alias("beliefs"))
        weighed = edges.join(beliefs, "instance", "left").withColumn(
            "weight", F.when(F.col("seed"), 1.0).otherwise(F.coalesce(F.try_element_at("beliefs", "kind"), F.lit(0.0))))
        by_kind = weighed.groupBy("pattern", "kind").agg(
            F.sum("weight").alias("held"), F.sum((F.col("weight") > 0).cast("long")).alias("n_known"),
            F.sum((F.col("counts") & ~F.col("seed") & F.col("beliefs").isNull()).cast("long")).alias("n_unknown"))
        summed = by_kind.groupBy("pattern").agg(
            F.sum(F.col("held") + F.col("n_unknown") * F.lit(UNKNOWN)).alias("total"),
            F.max(F.struct("n_known", "held", "kind")).alias("top"))
        good = summed.select("pattern", "top.*", (F.col("top.held") / F.col("total")).alias("confidence")).where(
            (F.col("n_known") >= support) & (F.col("confidence") >= confident))
        doubted = edges.where(~F.col("seed")).join(good.select("pattern", "kind", "confidence"), ["pattern", "kind"])
        # Doubts are multiplied as sums of logarithms, which combine before the shuffle.
        belief = 1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        found = doubted.groupBy("instance", "kind").agg(belief.alias("belief")).where(F.col("belief") >= accepted)
        known = settle(known.union(found.join(known, ["instance", "kind"], "left_anti")), "pii-known")
        size, before = known.count(), size
    return known


def _apart(starts, kinds, ends, beliefs) -> list[int]:
    """Places of the spans that stay where those of one kind overlap, by start, then kind."""
    taken: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    stay = []
    for k in sorted(range(len(starts)), key=lambda k: (-round(beliefs[k], 6), starts[k] - ends[k], starts[k])):
        span, own = (starts[k], ends[k]), taken[kinds[k]]
        at = bisect_left(own, span)
        if (at == 0 or own[at - 1][1] <= span[0]) and (at == len(own) or own[at][0] >= span[1]):
            insort(own, span)
            stay.append(k)
    return sorted(stay, key=lambda k: (starts[k], kinds[k]))


def find(docs: DataFrame, **settings) -> DataFrame:
    """Per document: doc_id, text_hash, counts and digest of the base spans, and all spans.

    `n_found` counts the spans that the patterns added.
    """
    scanned = settle(scan(docs), "pii-scan")
    mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    known = discover(mentions, **settings)
    met = mentions.where(~F.col("seed")).join(known, ["instance", "kind"]).groupBy("row").agg(
        F.collect_list(F.struct("start", "kind", "end", "belief")).alias("met"))

    @F.pandas_udf("array<int>")
    def apart(starts: pd.Series, kinds: pd.Series, ends: pd.Series, beliefs: pd.Series) -> pd.Series:
        return pd.Series([_apart(*row) for row in zip(starts, kinds, ends, beliefs, strict=True)], dtype=object)

    stay = met.withColumn("stay", apart("met.start", "met.kind", "met.end", "met.belief"))
    added = stay.select("row", F.expr(
        "transform(stay, k -> struct(met[k].start AS start, met[k].kind AS kind, met[k].end AS end))").alias("added"))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_sort(F.concat("base", F.coalesce("added", F.expr("array()").cast("array<struct<start:int,kind:int,end:int>>"))))
    spans = F.concat_ws(",", F.transform(every, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))
    return scanned.drop("mentions").join(added, "row", "left").select(
        "doc_id", "text_hash", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"),
        F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_found"))


def _redacted(text: str, spans: str) -> str:
    """Each stretch covered by spans becomes the name of the first span's kind in brackets."""
    out, end = [], 0
    for span in spans.split(","):
        kind, start, stop = span.split(":")
        start, stop = int(start), int(stop)
        if start >= end:
            out += [text[end:start], f"[{kind.upper()}]"]
        end = max(end, stop)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, **settings) -> DataFrame:
    """The documents, all columns kept, with the spans in `text` replaced; n_chars follows the text."""
    spans = find(docs, **settings).where("spans != ''").select(
        F.col("doc_id").alias("id_"), F.col("text_hash").alias("hash_"), F.col("spans").alias("spans_")).dropDuplicates(["id_", "hash_"])
    # The row goes along as one column, so that none of its columns can clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text_or_empty()).alias("hash"), packed(docs))
    joined = rows.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")), "left")

    @F.pandas_udf("string")
    def replaced(text: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else _redacted(t, s) for t, s in zip(text, found, strict=True)])

    names = {c.lower(): c for c in docs.columns}
    clean = joined.withColumn("clean", replaced(F.col("packed.text"), F.col("spans_")))
    changed = {names["text"]: F.col("clean")}
    if "n_chars" in names:
        counted = F.length("clean").cast(docs.schema[names["n_chars"]].dataType)
        changed[names["n_chars"]] = F.when(F.col("spans_").isNull(), F.col("packed.n_chars")).otherwise(counted)
    return clean.select(*[changed[c].alias(c) if c in changed else F.col(f"packed.`{c}`").alias(c) for c in docs.columns])
