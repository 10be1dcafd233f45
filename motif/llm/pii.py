"""Personal data by rules, and by bootstrapped contextual extraction.

Rules find e-mail addresses, IP addresses, card numbers and phone numbers. Their finds are the seeds. Every mention of an
identifier (a seed, a run of digit groups with at least four digits, or another token with an @ or as many digits) has two
lexical patterns, the two words before it and the two after it. Spark scores the graph of patterns and instances in rounds: a pattern's confidence for a kind is the mean score of the
distinct instances seen in it, if these bring enough support; an unseen instance's score is the chance that not all its
patterns are wrong. What stands in a pattern of high confidence with a high score is personal data of that kind.

A round joins the distinct (pattern, instance) pairs with the few confident patterns, and sums by instance; mentions are
found in one pass over the texts, so texts are never shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, exact, fitted, map_texts, materialize

KINDS = ("email", "ip", "card", "phone")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
HINT = re.compile(r"[0-9@]")
TOKEN = re.compile(r"[^\s<>()\[\]{},;\"']+")
WORD = re.compile(r"\S+")
GROUP = re.compile(r"[+]?[0-9][0-9./-]*")  # digit groups that stand side by side are one identifier
BETWEEN = re.compile(r"[ ()]{1,2}")
LEAST_DIGITS = 4
LONGEST = 64  # of longer words so many characters beside the mention count; longer instances are compared by digest


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: what is left of it up to the last match, then the domain."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text[start - 1]):
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of what the rules find, by kind, then start."""
    out = []
    if "@" in text:
        out += [(0, a, b) for a, b in _emails(text)]
    if DIGIT.search(text):
        out += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                out.append((3, *m.span()))
    return out


class Context:
    """The words of a text, for the patterns of its mentions: words in lower case, digits as 0; ^ and $ beyond the text."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def patterns(self, start: int, end: int) -> tuple[str, str]:
        before, after = ["^", "^"], ["$", "$"]
        k = bisect_left(self.starts, start)  # words that begin before the mention; the last may reach into it
        for i in range(max(0, k - 2), k):
            before.append(self.text[max(self.starts[i], (e := min(self.ends[i], start)) - LONGEST) : e])
        k = bisect_right(self.ends, end)
        for i in range(min(len(self.ends), k + 2) - 1, k - 1, -1):
            after.append(self.text[(a := max(self.starts[i], end)) : min(self.ends[i], a + LONGEST)])
        shown = lambda words: re.sub("[0-9]", "0", " ".join(words).lower())
        return "< " + shown(before[-2:]), "> " + shown(after[:-3:-1])


def _value(token: str) -> str:
    """A mention's instance: without separators, in lower case; a long one by its digest."""
    value = re.sub(r"[\s().-]", "", token.lower())
    return value if len(value) <= LONGEST else "#" + hashlib.md5(value.encode("utf-8", "surrogatepass")).hexdigest()


def _candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places of what looks like an identifier and meets no base span: tokens, and runs of digit groups side by side."""
    taken = _union([(a, b) for _, a, b in base])
    out, i, run = [], 0, None
    for m in TOKEN.finditer(text):
        a, b = m.span()
        if not HINT.search(text, a, b):
            continue
        while b > a and not text[b - 1].isalnum():
            b -= 1
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        if b == a or i < len(taken) and taken[i][0] < b:
            continue
        if not GROUP.fullmatch(text, a, b):
            out.append((a, b))
        elif run and BETWEEN.fullmatch(text, run[1], a):
            run[1] = b
        else:
            run = [a, b]
            out.append(run)
    return [(a, b) for a, b in out if text.find("@", a, b) >= 0 or len(DIGIT.findall(text, a, b)) >= LEAST_DIGITS]


def _union(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, str, str, int, int]]:
    """(kind or -1, pattern, instance, start, end), twice each, of seeds and of other places that look like identifiers."""
    if not HINT.search(text):
        return []
    found = [*base, *((-1, a, b) for a, b in _candidates(text, base))]
    context = Context(text) if found else None
    return [(k, p, _value(text[a:b]), a, b) for k, a, b in found for p in context.patterns(a, b)]


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs: row, doc_id, tid, counts, base_sha256, base spans, mentions. A null text is empty."""

    def run(texts: list) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "mentions")}
        for t in texts:
            t = t or ""
            base = base_spans(t)
            for k, name in enumerate(("n_email", "n_ip", "n_card", "n_phone")):
                out[name].append(sum(x[0] == k for x in base))
            out["base_sha256"].append(digest(base))
            out["base"].append([dict(zip(("kind", "start", "end"), x)) for x in base])
            out["mentions"].append([dict(zip(("kind", "pattern", "value", "start", "end"), x)) for x in mentions(t, base)])
        return out

    rows = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").withColumn("row", F.monotonically_increasing_id())
    fields = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<kind:int,start:int,end:int>>, mentions array<struct<kind:int,pattern:string,value:string,start:int,end:int>>"
    return materialize(map_texts(rows, "text", ["row", "doc_id", "tid"], lambda: run, fields), "mentions")


def discover(scanned: DataFrame, rounds: int = 3, support: float = 3.0, confidence: float = 0.9) -> DataFrame:
    """(row, doc_id, tid, kind, start, end) of mentions that only their patterns give away.

    support: so many distinct instances of a kind, weighted by score, a pattern needs; confidence: the least confidence
    of a pattern and score of an instance. Copies of a text add no instances, so they lend no support.
    """
    each = scanned.select("row", "doc_id", "tid", F.explode("mentions").alias("m")).select("row", "doc_id", "tid", "m.*")
    many = scanned.agg(F.coalesce(F.sum(F.size("mentions")), F.lit(0))).first()[0]
    pairs = materialize(fitted(each.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), many), "pairs")
    many = pairs.count()
    sizes = pairs.groupBy("pattern").agg(F.count("*").alias("n"))
    scores = pairs.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
    patterns = None
    for _ in range(rounds):
        held = pairs.drop("kind").join(scores, "value")
        sums = held.groupBy("pattern", "kind").agg(F.sum("score").alias("s"), F.count("*").alias("seen")).where(F.col("s") >= support)
        patterns = sums.join(sizes, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("conf")).where(F.col("conf") >= confidence / 2)
        patterns = materialize(fitted(patterns, many), "patterns")
        new = pairs.where("kind < 0").drop("kind").join(patterns, "pattern")
        new = new.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("conf", F.lit(0.999)))))).alias("score"))
        seeds = pairs.where("kind >= 0").select("value", "kind", F.lit(1.0).alias("score")).distinct()
        scores = materialize(fitted(seeds.unionByName(new).groupBy("value", "kind").agg(F.max("score").alias("score")), many), "scores")
    good = patterns.where(F.col("conf") >= confidence)
    found = each.where("kind < 0").drop("kind").join(good, "pattern").join(scores.where(F.col("score") >= confidence), ["value", "kind"])
    best = F.max(F.struct("score", -F.col("kind"))).alias("best")
    return found.groupBy("row", "doc_id", "tid", "start", "end").agg(best).select("row", "doc_id", "tid", (-F.col("best.col2")).alias("kind"), "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans and n_spans of every row of docs (doc_id, text, any more columns).

    A null or empty text has no spans. Repeated rows stay and get equal results; a missing doc_id stays missing. An
    empty table gives no rows.
    """
    scanned = scan(docs)
    found = discover(scanned).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    every = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.transform("all", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    joined = scanned.drop("mentions").join(found, "row", "left").withColumn("all", every)
    return joined.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(text, ",").alias("spans"), F.size("all").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span replaced by its kind in brackets; n_chars, if there, follows the text. No row is dropped."""
    spans = discover(scan(docs)).withColumn("_motif_doc", F.coalesce("doc_id", F.lit(NO_ID)))
    spans = spans.select("_motif_doc", F.col("tid").alias("_motif_tid"), F.struct("kind", "start", "end").alias("s")).distinct()
    spans = spans.groupBy("_motif_doc", "_motif_tid").agg(F.collect_list("s").alias("_motif_more"))
    keyed = docs.withColumn("_motif_doc", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("_motif_tid", F.xxhash64("text"))
    joined = keyed.join(spans, ["_motif_doc", "_motif_tid"], "left").withColumn("_motif_pair", F.struct("text", "_motif_more"))

    def make() -> Callable[[list], dict]:
        def run(rows: list) -> dict:
            out = []
            for row in rows:
                text = row["text"]
                if text:
                    spans = base_spans(text) + [(s["kind"], s["start"], s["end"]) for s in row["_motif_more"] or ()]
                    parts, at = [], 0
                    for a, b, k in sorted((a, b, k) for k, a, b in spans):
                        if a >= at:
                            parts += [text[at:a], f"[{KINDS[k].upper()}]"]
                        at = max(at, b)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            return {"text": out}

        return run

    done = map_texts(joined, "_motif_pair", [c for c in docs.columns if c != "text"], make, "text string")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*map(exact, docs.columns))
