"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint's 64 bits are cut into two segments. Two fingerprints that differ in at most three bits have a segment in
which they differ in at most one, so they share one of that segment's 32 one-wildcard variants (the segment without one
bit). Variants are shuffled by value, the groups of equal variants are read in order, and members are verified.

A group of more than `cap` distinct fingerprints is not compared as it is. Its members get finer keys: the bits that are
still free are cut into four blocks; of two fingerprints with three or fewer differences, one block must be equal, so
each member goes to four smaller groups. A group with b free bits has 2^b members at most, so this ends, is exact, and
no task ever holds more than `cap` members or 2^12. Very crowded groups are known from a sample and never even meet.

Three bits of 64 mean almost equal texts. Where a similarity of word shingles is asked for (similar_groups), the same steps come
first: fingerprints of all shingles, variants, verified bits; then the pairs are compared exactly. For similar texts that are more
bits apart a text has further fingerprints, each of a few shingles that min-hashing draws from its set; texts that share one
are compared exactly too, unless they are linked already.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import component_ids, connected_components, exact, fitted, map_texts, materialize

DISTANCE = 3
SEED = 42
ROWS = 1 << 16  # shingles whose bits are held at once
PART = 1 << 20  # bytes of a text whose words are held at once
SPACE = re.compile(rb"[ \t-\r]")
PLAIN = 32  # groups up to this size are compared pair by pair
PAIRED = 6  # of drawn shingles: larger groups that hold several components go through the prefix filter
FREE = 12  # with so few free bits a group is never split further
SKEW_SAMPLE = 20_000  # fingerprints that are looked at to find crowded groups early
DRAWS, DRAWN = 24, 6  # fingerprints of drawn shingles and the shingles in each: of pairs with Jaccard 0.8, 1 - (1 - 0.8^6)^24 = 0.999 share one


def fingerprint(text: str | None, width: int = 3) -> int:
    """The unsigned fingerprint of a text; a null or wordless text has 0."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z change, only \x20 and \x09-\x0D part words
    votes, n, words = np.zeros(64, dtype=np.int64), 0, []
    for at, end in _parts(raw):
        words += raw[at:end].split()
        if len(words) >= width:
            n += _vote(words, width, votes)
            words = words[len(words) - width + 1 :]
    if not n and words:
        n = _vote(words, len(words), votes)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0]) if n else 0


def _parts(raw: bytes) -> Iterator[tuple[int, int]]:
    """Slices of about PART bytes that end at white space."""
    at = 0
    while at < len(raw):
        cut = SPACE.search(raw, at + PART)
        end = cut.start() if cut else len(raw)
        yield at, end
        at = end


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    """The hashes of all shingles of the words."""
    whole, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return np.array([hash64(whole[i:j], SEED) for i, j in zip(starts, (ends[width - 1 :] - 1).tolist())], dtype="<u8")


def _vote(words: list[bytes], width: int, votes: np.ndarray) -> int:
    """Adds the bits of all shingles to the votes; returns how many shingles there are."""
    hashes = _hashes(words, width)
    _count(hashes, votes)
    return len(hashes)


def _count(hashes: np.ndarray, votes: np.ndarray) -> None:
    for at in range(0, len(hashes), ROWS):
        part = hashes[at : at + ROWS]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) of every row; fp holds the unsigned fingerprint's bits in a long."""
    made = lambda texts: {"fp": np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)}
    return map_texts(docs, "text", ["doc_id"], lambda: made, "fp long")


def _close(group: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a group's links: breadth first, each member once in the front."""
    left = group.view(np.uint64).copy()
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            near = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 256):
                near |= (np.bitwise_count(front[at : at + 256, None] ^ left[None, :]) <= DISTANCE).any(axis=0)
            front, left = left[near], left[~near]
            for x in front:
                yield int(root.view(np.int64)), int(x.view(np.int64))


def _links(cap: int):
    """Reads rows (mask, val, fp) sorted; yields links (mask null) and the members of groups that are too large."""

    def small(mask: np.ndarray, val: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])
        group = np.cumsum(new)
        sizes = np.bincount(group)[group]
        u, a, b = fp.view(np.uint64), [], []
        few = sizes <= PLAIN
        for shift in range(1, PLAIN):
            i = np.flatnonzero((group[shift:] == group[:-shift]) & few[shift:])
            if not len(i):
                break
            i = i[np.bitwise_count(u[i] ^ u[i + shift]) <= DISTANCE]
            a.append(fp[i])
            b.append(fp[i + shift])
        for g in np.unique(group[~few]):
            for x, y in _close(fp[group == g]):
                a.append([x])
                b.append([y])
        if a and (a := np.concatenate(a)).size:
            pairs = np.unique(np.stack([a, np.concatenate(b)]), axis=1)
            yield pd.DataFrame({"mask": pd.array([None] * pairs.shape[1], dtype="Int64"), "a": pairs[0], "b": pairs[1]})

    def too_large(mask: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"mask": pd.array(mask, dtype="Int64"), "a": fp, "b": fp})

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept, large = None, None  # the rows of the last, perhaps unfinished group; the key of a group that is too large
        for batch in batches:
            mask, val, fp = (batch[c].to_numpy(np.int64) for c in ("mask", "val", "fp"))
            if large is not None:
                same = (mask == large[0]) & (val == large[1])
                if same.any():
                    yield too_large(mask[same], fp[same])
                mask, val, fp = mask[~same], val[~same], fp[~same]
                if not len(fp):
                    continue
                large = None
            if kept is not None:
                mask, val, fp = (np.concatenate(x) for x in zip(kept, (mask, val, fp)))
            if not len(fp):
                continue
            last = (mask == mask[-1]) & (val == val[-1])
            begin = int(np.argmax(last))
            yield from finish(mask[:begin], val[:begin], fp[:begin])
            kept = mask[begin:], val[begin:], fp[begin:]
            if len(kept[2]) > cap and 64 - int(np.bitwise_count(kept[0][:1].view(np.uint64))[0]) > FREE:
                yield too_large(kept[0], kept[2])
                large, kept = (kept[0][0], kept[1][0]), None
        if kept is not None:
            yield from finish(*kept)

    def finish(mask: np.ndarray, val: np.ndarray, fp: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(fp):
            return
        new = np.ones(len(fp), dtype=bool)
        new[1:] = (mask[1:] != mask[:-1]) | (val[1:] != val[:-1])
        sizes = np.bincount(np.cumsum(new))[np.cumsum(new)]
        large = (sizes > cap) & (64 - np.bitwise_count(mask.view(np.uint64)) > FREE)
        if large.any():
            yield too_large(mask[large], fp[large])
        yield from small(*(x[(sizes > 1) & ~large] for x in (mask, val, fp)))

    return of


def _grouped(keyed: DataFrame, cap: int) -> DataFrame:
    rows = keyed.select("mask", "val", "fp").repartition("mask", "val").sortWithinPartitions("mask", "val")
    return rows.mapInPandas(_links(cap), "mask long, a long, b long")


def _crowded(keyed: DataFrame, members: int, cap: int) -> DataFrame:
    """(mask, val) of groups that a sample of SKEW_SAMPLE fingerprints shows to be above the cap.

    Their members go on to finer keys without meeting in a task. What the sample misses is found when groups are read, so
    it decides about the way only, not about the links. Groups with few free bits stay.
    """
    step = max(1, members // SKEW_SAMPLE)
    sampled = keyed.where(F.pmod(F.xxhash64("fp"), F.lit(step)) == 0).groupBy("mask", "val").agg(F.count("*").alias("n"))
    return sampled.where((F.col("n") > cap / step) & (F.bit_count("mask") < 64 - FREE) & ((F.col("n") >= 20) | F.lit(step == 1))).drop("n")


def _pass(keyed: DataFrame, members: int, cap: int) -> DataFrame:
    """One pass over keyed fingerprints: links (mask null) and members of groups that need finer keys."""
    keyed = keyed.withColumn("val", F.col("fp").bitwiseAND(F.col("mask")))
    crowded = materialize(fitted(_crowded(keyed, members, cap), 64 * SKEW_SAMPLE // 20), "crowded")
    if crowded.isEmpty():
        return materialize(_grouped(keyed, cap), "links")
    crowded = F.broadcast(crowded)  # 64 * SKEW_SAMPLE / 20 rows at most
    on = ["mask", "val"]
    finer = keyed.join(crowded, on, "left_semi").select("mask", F.col("fp").alias("a"), F.col("fp").alias("b"))
    return materialize(_grouped(keyed.join(crowded, on, "left_anti"), cap).unionByName(finer), "links")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _variants(classes: DataFrame) -> DataFrame:
    """64 rows (mask, fp) of each distinct fingerprint: a segment without one of its bits."""
    masks = [_signed((0xFFFFFFFF << 32 * s) & ~(1 << 32 * s + i)) for s in (0, 1) for i in range(32)]
    return classes.select(F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"), "fp")


def _finer(members: DataFrame) -> DataFrame:
    """Four rows of each member, each with one more block of the free bits in its mask."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, list[int]] = {}
        for b in batches:
            for m in b["mask"].unique():
                if m not in known:
                    free = [i for i in range(64) if not (int(m) >> i) & 1]
                    known[m] = [_signed((int(m) | sum(1 << i for i in block)) & (2**64 - 1)) for block in np.array_split(free, DISTANCE + 1) for block in [[int(x) for x in block]]]
            for k in range(DISTANCE + 1):
                yield pd.DataFrame({"mask": b["mask"].map(lambda m, k=k: known[m][k]).astype("int64"), "fp": b["a"]})

    return members.select("mask", "a").mapInPandas(of, "mask long, fp long")


def fingerprint_links(classes: DataFrame, cap: int = 4096) -> DataFrame:
    """(a, b): links between the distinct fingerprints (fp) that connect all with at most DISTANCE differing bits.

    Within a crowded group only a spanning forest is kept, so the links grow with the members, not with their pairs.
    """
    found = _pass(_variants(classes.select("fp")), classes.count(), cap)
    out = found.where("mask is null").select("a", "b")
    while rest := (left := found.where("mask is not null").select("mask", "a").distinct()).select("a").distinct().count():
        found = _pass(_finer(left).distinct(), rest, cap)
        out = out.unionByName(found.where("mask is null").select("a", "b"))
    return out


def simhash_groups(docs: DataFrame, width: int = 3, cap: int = 4096) -> DataFrame:
    """doc_id, fp, root, component_id of every row of docs (doc_id, text, any more columns).

    Null and wordless texts have fingerprint 0 and link like any other. Rows with equal fingerprints are one class,
    whatever their ids; repeated rows stay, with equal results. component_id is the least non-null doc_id that is
    reachable, null if there is none. root names the component even then. An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, width), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    labels = component_ids(classes, fingerprint_links(classes, cap), "fp", "rep")
    return rows.join(labels.select("fp", "root", "component_id"), "fp")


def hex_of(fp: str = "fp"):
    """16 lowercase hex digits of a long's bits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than width are one shingle, no words none."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    out, words = [], []
    for at, end in _parts(raw):
        words += raw[at:end].split()
        if len(words) >= width:
            out.append(_hashes(words, width))
            words = words[len(words) - width + 1 :]
    if not out and words:
        out.append(_hashes(words, len(words)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype="<u8")


def set_fingerprint(found: np.ndarray) -> int:
    """The unsigned fingerprint of a set of shingles, each counted once; of an empty one 0."""
    votes = np.zeros(64, dtype=np.int64)
    _count(found, votes)
    return int(np.packbits(2 * votes > len(found), bitorder="little").view("<u8")[0])


def _drawn(found: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """The DRAWS fingerprints of a set of shingles, each over the DRAWN least under as many orders."""
    least = np.full(DRAWS * DRAWN, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(found), 1024):
        least = np.minimum(least, ((found[None, at : at + 1024] ^ mix[0][:, None]) * mix[1][:, None]).min(axis=1))
    bits = np.unpackbits(least.astype("<u8").view(np.uint8).reshape(DRAWS, DRAWN, 8), axis=2, bitorder="little")
    return np.packbits(2 * bits.sum(axis=1) > DRAWN, axis=1, bitorder="little").view("<u8").reshape(-1)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, t (a hash of the text), id (a digest of the set of shingles), n (its size), fp (its fingerprint) and keys of every row."""

    def make():
        mix = np.random.default_rng(SEED).integers(0, 2**64, (2, DRAWS * DRAWN), dtype=np.uint64)
        mix[1] |= np.uint64(1)

        def run(texts: list) -> dict:
            sets = [shingles(t, width) for t in texts]
            ids = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([set_fingerprint(s) for s in sets], dtype=np.uint64).view(np.int64)
            return {"id": ids, "n": [len(s) for s in sets], "fp": fps, "keys": [_drawn(s, mix).view(np.int64) for s in sets]}

        return run

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    return map_texts(keyed, "text", ["doc_id", "t"], make, "id long, n long, fp long, keys array<long>")


def _sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, s): the sorted distinct shingles of the wanted classes (id)."""
    few = classes.join(wanted.select("id").distinct(), "id", "left_semi").select("id", "t")
    texts = docs.select(F.xxhash64("text").alias("t"), "text").join(few, "t").groupBy("id").agg(F.min("text").alias("text"))
    made = lambda texts: {"s": [shingles(t, width).view(np.int64) for t in texts]}
    return map_texts(texts, "text", ["id"], lambda: made, "s array<long>")


def _verified(pairs: DataFrame, rows: int, classes: DataFrame, docs: DataFrame, similarity: float, width: int) -> DataFrame:
    """Of at most about `rows` pairs (a, b) of classes, those whose sets of shingles have at least that Jaccard
    similarity, computed exactly."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(fitted(pairs, rows), "pairs")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
    # Both ends of a pair meet by the pair, so the sets are made once and a class with many pairs is no hot key here.
    met = ends.join(_sets(ends, classes, docs, width), "id").groupBy("a", "b").agg(F.min(F.struct("id", "s")).alias("x"), F.max(F.struct("id", "s")).alias("y"))
    met = met.select("a", "b", F.size("x.s").alias("m"), F.size("y.s").alias("n"), F.size(F.array_intersect("x.s", "y.s")).alias("both"))
    similar = met.where(F.col("both") >= similarity * (F.col("m") + F.col("n") - F.col("both")) - 1e-9).select("a", "b")
    return materialize(fitted(similar, pairs.count(), 2500), "similar")


def _close_classes(classes: DataFrame) -> DataFrame:
    """(a, b): classes (id, fp) with equal fingerprints, each with the first of them, and the first ones of fingerprints that
    fingerprint_links links."""
    firsts = materialize(classes.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    links = fingerprint_links(firsts)
    a, b = firsts.select(F.col("fp").alias("a"), F.col("first").alias("x")), firsts.select(F.col("fp").alias("b"), F.col("first").alias("y"))
    equal = classes.join(firsts, "fp").where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b"))
    return equal.unionByName(links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def _near(n: str, m: str, similarity: float) -> F.Column:
    """Whether sets of n and m shingles can have that Jaccard similarity."""
    return F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9


def _crowded_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of members (id, n, root) of different roots that may be similar, by an exact prefix filter.

    With shingles in order of falling rarity among the members, two sets that are similar share one of their first
    n - similarity * n + 1. What a member shares with nobody counts for its prefix but brings no pair, so a copy with many
    edits of its own meets nobody. Pairs whose shared shingles can't suffice any more from where they meet are left out.
    """
    shingle = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("shingle"))
    shared = shingle.groupBy("shingle").agg(F.count("*").alias("f")).where("f > 1")
    own = Window.partitionBy("id")
    held = shingle.join(shared, "shingle").withColumns({"m": F.count("*").over(own), "at": F.row_number().over(own.orderBy("f", "shingle"))})
    held = held.withColumn("at", F.col("at") + F.col("n") - F.col("m")).where(F.col("at") <= F.col("n") - F.ceil(similarity * F.col("n") - 1e-9) + 1)
    enough = lambda both, n, m: both >= similarity / (1 + similarity) * (n + m) - 1e-9
    held = held.join(members.select("id", "root"), "id")
    least = held.groupBy("shingle").agg(F.min("n").alias("least"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").drop("r0", "r1")
    held = held.join(least, "shingle").where(enough(F.col("m"), F.col("n"), F.col("least"))).drop("least")
    x = held.select("shingle", F.col("id").alias("a"), "n", "m", "at", "root")
    y = held.select("shingle", F.col("id").alias("b"), *[F.col(c).alias("y_" + c) for c in ("n", "m", "at", "root")])
    most = F.least("m", "y_m", 1 + F.col("n") - F.col("at"), 1 + F.col("y_n") - F.col("y_at"))
    met = x.join(y, "shingle").where((F.col("a") < F.col("b")) & (F.col("root") != F.col("y_root")) & _near("n", "y_n", similarity))
    return met.where(enough(most, F.col("n"), F.col("y_n"))).select("a", "b")


def similar_groups(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """doc_id, root, component_id of every row of docs: groups linked by a Jaccard similarity of word shingles.

    Rows with equal sets of shingles are one class. Classes whose fingerprints differ in at most three bits are found by
    deletion variants and compared. Classes that share a fingerprint of drawn shingles and are not linked by then meet: first each
    with one class of the group, the one that meets most others, so near copies of one text cost one comparison each.
    Of groups that this left in several components, the small ones compare all pairs across components; the members of
    larger ones go through an exact prefix filter instead, so a crowd of copies that are too different from each
    other isn't compared pair by pair. So every pair that meets is compared, known to be too different, or already
    linked. All comparisons are exact; null and wordless texts are one class.
    """
    rows = materialize(_sketches(docs, width), "sketches")
    classes = rows.groupBy("id").agg(F.min("t").alias("t"), F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "fp", "keys")])
    classes = materialize(classes, "classes")
    close = materialize(_close_classes(classes.where("n > 0").select("id", "fp")), "close")
    linked = _verified(close, close.count(), classes, docs, similarity, width)
    own = connected_components(linked)
    root = F.coalesce("root", "id").alias("root")
    keyed = classes.where("n > 0").select("id", "n", F.posexplode("keys").alias("k", "key"))
    keyed = keyed.select("id", "n", F.xxhash64("k", "key").alias("key"))
    met = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "key"), "met")
    size = met.count()
    weighed = met.join(met.groupBy("id").agg(F.sum("c").alias("w")), "id")
    met = met.join(own.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "n", "c", root)
    centres = weighed.groupBy("key").agg(F.max(F.struct("w", "id", "n")).alias("z")).select("key", F.col("z.id").alias("centre"), F.col("z.n").alias("m"))
    centres = centres.join(own.select(F.col("node").alias("centre"), F.col("root").alias("z")), "centre", "left").withColumn("z", F.coalesce("z", "centre"))
    stars = met.join(centres, "key").where((F.col("root") != F.col("z")) & _near("n", "m", similarity))
    links = _verified(stars.select(F.col("id").alias("a"), F.col("centre").alias("b")), size, classes, docs, similarity, width).unionByName(linked)
    roots = component_ids(classes.select("id", "rep"), links, "id", "rep").select("id", "root")
    met = met.drop("root").join(roots, "id")
    apart = met.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("key")
    met = materialize(fitted(met.join(apart, "key", "left_semi"), size), "apart")
    few = met.where(F.col("c") <= PAIRED)
    others = few.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
    pairs = few.join(others, "key").where((F.col("id") < F.col("b")) & (F.col("root") != F.col("other")) & _near("n", "m", similarity))
    pairs = pairs.select(F.col("id").alias("a"), "b")
    members = materialize(fitted(met.where(F.col("c") > PAIRED).select("id", "n", "root").distinct(), size), "members")
    if not members.isEmpty():
        pairs = pairs.unionByName(_crowded_pairs(members, _sets(members, classes, docs, width), similarity))
    links = links.unionByName(_verified(pairs, size, classes, docs, similarity, width))
    labels = component_ids(classes.select("id", "rep"), links, "id", "rep")
    return rows.select("doc_id", "id").join(labels.select("id", "root", "component_id"), "id").drop("id")


def deduplicate(docs: DataFrame, width: int = 3, cap: int = 4096) -> DataFrame:
    """The rows of docs that stay: one document of each group of simhash_groups, the one with the least doc_id.

    Rows that repeat a kept doc_id are the same document; one of them stays. A row without doc_id can't be named by a
    decision and stays.
    """
    return _first_of(docs, simhash_groups(docs, width, cap))


def deduplicate_similar(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """As deduplicate, with the groups of similar_groups."""
    return _first_of(docs, similar_groups(docs, similarity, width))


def _first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = named.select(*map(exact, docs.columns), F.row_number().over(first).alias("_motif_n")).where("_motif_n = 1").drop("_motif_n")
    return named.unionByName(docs.where("doc_id is null"))
