"""DuckDB SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def crc_table() -> list[int]:
    """What eight steps of the checksum's division make of each byte."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ 0xEDB88320 if n & 1 else n >> 1
        out.append(n)
    return out


def resample(percent: int = 5, least_words: int = 20, seed: int = 42) -> str:
    """Words, runs, checksums byte by byte, gains, weights and ranks, each as its definition says."""
    table = ", ".join(map(str, crc_table()))
    words = lambda t: rf"(SELECT id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {t})"
    two, three = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])", "list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])"
    runs = lambda t: f"SELECT id, unnest(list_concat(w, {two}, {three})) AS f FROM {t}"
    return rf"""WITH d AS {words("(SELECT doc_id AS id, text FROM documents)")}, b AS {words("(SELECT item_id AS id, text FROM benchmark)")},
df AS (SELECT id, f, count(*) AS n FROM ({runs("d")}) GROUP BY ALL), bf AS (SELECT f, count(*) AS n FROM ({runs("b")}) GROUP BY ALL),
f AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, list_extract([{table}]::BIGINT[], xor(c & 255, x) + 1))), 4294967295) % 10000 AS bucket FROM f),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN crc USING (f) GROUP BY 1), t AS (SELECT bucket, sum(n) AS t FROM bf JOIN crc USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM df) + 10000)::DOUBLE
  / ((s + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM bf), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS weight FROM df JOIN crc USING (f) JOIN g USING (bucket) GROUP BY id),
a AS (SELECT d.id AS doc_id, len(d.w)::BIGINT AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || d.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN w USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= {least_words}) AS every FROM a)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= {least_words} AND place <= {percent} * every // 100 THEN place END AS rank, n_words FROM r"""


ORACLES = {"op11_resample": resample()}
