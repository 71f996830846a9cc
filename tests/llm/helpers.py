"""Brute-force versions that the operators are held against."""

import re

import numpy as np
import xxhash

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = [None, "", " \n\t ", "a", "a a a", "One. Two! Three?\n\nFour", "x" * 50_000, "word " * 20_000, "é̂ 😀 ß Ⅷ ２ \x1f\x85 ", "<|endoftext|> </s>[INST] <b>&amp;"]


def documents(spark, texts, extra=False):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # columns named like those the operators use inside
        for c in ("row", "rep", "cell", "component_id", "score", "hash", "shard", "ids", "s", "e", "h", "cut_id", "node", "gone_id", "key_id", "host"):
            df = df.withColumn(c, __import__("pyspark.sql.functions", fromlist=["lit"]).lit("own"))
    return df


def fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0d]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, fps, distance):
    label = dict.fromkeys(ids)
    for i in ids:
        label[i] = i
    f = np.array([fps[i] for i in ids], np.uint64)
    order = list(ids)
    changed = True
    while changed:
        changed = False
        for i, x in zip(order, f):
            low = min(label[order[j]] for j in np.flatnonzero(np.bitwise_count(f ^ x) <= distance))
            if low < label[i]:
                label[i], changed = low, True
    return label
