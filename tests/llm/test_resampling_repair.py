import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from chartloom.llm import conversation_repair as C
from chartloom.llm import importance_resampling as I
from chartloom.llm import queries
from chartloom.llm import weighted_sampling as W

from .helpers import EDGES, SF, documents

CLASHES = ("word", "term", "side", "block", "hash", "id", "known", "copies", "_range", "start", "bucket", "n", "score", "rank", "fault", "gone", "time", "harm")


def clashing(df, skip=()):
    from pyspark.sql import functions as F

    for c in CLASHES:
        if c not in df.columns and c not in skip:
            df = df.withColumn(c, F.lit("own"))
    return df


# importance resampling


def runs(text):
    words = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())
    return words, words + [a + b" " + b for a, b in itertools.pairwise(words)]


def resampled(rows, target, percent=25, least=20, buckets=10_000, seed=7):
    s, t = Counter(), Counter()
    for texts, counts in (([x for _, x in rows], s), (target, t)):
        for x in texts:
            counts.update(zlib.crc32(f) % buckets for f in runs(x)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)}
    out = []
    for doc_id, text in rows:
        words, features = runs(text)
        weight = sum(gain[zlib.crc32(f) % buckets] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = i
    return sorted((tuple(r[:5]) for r in out), key=repr)


def test_resampling_is_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    target = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = queries.op12_resampling(spark, SF)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
    assert sorted(map(tuple, got.collect()), key=repr) == resampled([tuple(r) for r in docs], target)


@pytest.mark.parametrize("nodes", [I.TRIE_WORDS, 3])
def test_resampling_edges(spark, monkeypatch, nodes):
    monkeypatch.setattr(I, "TRIE_WORDS", nodes)
    texts = [*EDGES, *["word again and again " * 10] * 3, "Ünï É ß Ⅷ " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id " * 20)] * 2 + [(3, "word again " * 15)]
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    target = ["word again", None, "", "É ß"]
    got = I.resample(docs, clashing(spark.createDataFrame([(t,) for t in target], "text string")))
    assert sorted(map(tuple, got.collect()), key=repr) == resampled(rows, target)
    empty = docs.limit(0)
    assert I.resample(empty, empty).count() == 0


@pytest.mark.parametrize(("longest", "nodes"), [(1, 2), (2, 2), (2, 10**6), (3, 5)])
def test_tries_that_start_anew_lose_nothing(spark, monkeypatch, longest, nodes):
    monkeypatch.setattr(I, "_WINDOW", 16)
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["the", "cat", "é", "sat", "x" * 40]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    want, per = Counter(), []
    for t in texts:
        words = t.encode().split()
        own = [b" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]
        want.update(zlib.crc32(f) % 50 for f in own)
        per.append((len(words), len(own), sum(zlib.crc32(f) % 50 for f in own) // max(1, len(own))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert dict(map(tuple, I.bucket_counts(docs, longest, 50, nodes).collect())) == want
    got = I.scored(docs, list(range(50)), longest, nodes).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == per


def test_long_texts_are_read_in_windows():
    text = b"A bc " * 200_000
    assert [w for part in I.words_of(text) for w in part] == text.lower().split()
    assert [w for part in I.words_of(b"x" * 1_000_000) for w in part] == [b"x" * 1_000_000]


# conversation repair


def cheapest(rows):
    """(cost, audit, turns) of the best edits of [(role, text, fault)] by search over everything that could be best."""
    best = {("", ""): (0, [])}  # (roles so far as the last state, audit) -> cost, turns

    def step(state, role):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role[:1]))

    def insert(all_):
        more = dict(all_)
        for _ in range(3):
            for (state, audit), (cost, turns) in list(more.items()):
                for name in ("user", "assistant"):
                    if (to := step(state, name)) and audit.endswith("I" * 3) is False:
                        key = (to, audit + "I")
                        if key not in more or cost + 5 < more[key][0]:
                            more[key] = (cost + 5, turns + [name + ":"])
        return more

    best = insert(best)
    for role, text, fault in rows:
        after = {}

        def offer(key, value):
            if key not in after or value[0] < after[key][0]:
                after[key] = value

        for (state, audit), (cost, turns) in best.items():
            offer((state, audit + "D"), (cost + 2, turns))
            if fault in (1, 2):
                continue
            extra = 5 if fault == 3 else 0
            if to := step(state, role):
                offer((to, audit + "K"), (cost + extra, turns + [f"{role}:{text}"]))
            for name in ("user", "assistant"):
                if to := step(state, name):
                    offer((to, audit + "R"), (cost + extra + 1, turns + [f"{name}:{text}"]))
        best = insert(after)
    return min((cost, audit, turns) for (state, audit), (cost, turns) in best.items() if state in ("", "a"))


def least_by_state(rows):
    """The same by the least (cost, audit, turns) of each state, for longer conversations."""
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def put(layer, state, *value):
        if state is not None and (state not in layer or value < layer[state]):
            layer[state] = value

    def insert(layer):
        for _ in range(4):
            for state, (cost, audit, turns) in list(layer.items()):
                for name in ("user", "assistant"):
                    put(layer, steps.get((state, name[0])), cost + 5, audit + "I", [*turns, name + ":"])
        return layer

    layer = insert({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, turns) in layer.items():
            put(after, state, cost + 2, audit + "D", turns)
            if fault not in (1, 2):
                extra = 5 * (fault == 3)
                put(after, steps.get((state, role[:1])), cost + extra, audit + "K", [*turns, f"{role}:{text}"])
                for name in ("user", "assistant"):
                    put(after, steps.get((state, name[0])), cost + extra + 1, audit + "R", [*turns, f"{name}:{text}"])
        layer = insert(after)
    return min(layer[s] for s in ("", "a"))


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        stripped = text.strip(" \t\n\x0b\x0c\r")
        out.append(1 if not stripped else 2 if (role, text) in seen else 3 if stripped[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def repaired(conv_id, rows, search=least_by_state):
    """rows: (turn, role, text) in order."""
    found = faults([r[1:] for r in rows])
    cost, audit, turns = search([(role, text, f) for (_, role, text), f in zip(rows, found, strict=True)])
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (conv_id, gaps, *(found.count(k) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def harmed(rows):
    out = {}
    for conv_id, turn, role, text in rows:
        own = out.setdefault(conv_id, [])
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        own += [(turn, "user" if harm == 4 else role, text)] * {0: 0, 3: 2}.get(harm, 1)
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for k, v in out.items()}


def check_repair(got, rows):
    want = sorted((repaired(k, v) for k, v in harmed(rows).items()), key=repr)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_repair_is_a_search_over_all_edits(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_repair(spark, SF)
    assert [k for _, k in got.dtypes] == ["bigint"] * 7 + ["string"] * 2
    check_repair(got, rows)


def test_repair_edges(spark):
    rng = random.Random(2)
    texts = ["Yes.", "no", "", " \n", None, "Why?", "yes.", "Ünï! ", "x" * 5000]
    roles = ["user", "assistant", "system", None, "tool", "user", "assistant", "System"]
    rows = []
    for conv in [*range(120), None]:
        for _ in range(rng.randint(1, 7)):
            rows.append((conv, rng.choice([None, *range(6), 9]), rng.choice(roles), rng.choice(texts)))
    rows = sorted({r[:2]: r for r in rows}.values(), key=repr) + [(500, 1, "user", "Same."), (500, 1, "user", "Same."), (501, None, None, None)]
    df = clashing(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), skip=("gone",))
    check_repair(C.repair(C.damaged(df)), rows)
    assert C.repair(C.damaged(df.limit(0))).count() == 0
    assert C.repair(df.limit(1)).count() == 1


def test_paths_stay_least_when_prefixes_are_set_aside_and_states_pruned():
    rng = random.Random(6)
    for _ in range(60):
        rows = [(rng.choice(["user", "assistant", "system", "user", "assistant", "x"]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(rng.randint(1, 4))]
        conversation = C.Conversation(1)
        for i, (role, text, fault) in enumerate(rows):
            conversation.add(i, role, text, fault)
        cost, audit, turns = cheapest(rows)
        assert (cost, audit, turns) == least_by_state(rows)
        assert conversation.result()[6:] == (cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def test_a_long_conversation_holds_a_short_audit():
    conversation, rng = C.Conversation(1), random.Random(3)
    most = 0
    for i in range(20_000):
        conversation.add(i, rng.choice(["user", "assistant", "assistant", "system"]), f"text {i}.", rng.choice([0, 0, 0, 1, 3]))
        most = max(most, *(len(p.audit) for p in conversation.layer.values()))
    assert most < 1000 and len(conversation.result()[7]) >= 20_000


# consistent weighted sampling


def terms(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    return Counter(words or ([text] if text else []))


def similarity(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_fingerprints_of_edited_texts(spark):
    texts = [*EDGES, "?!", "?!", "Again and again, " * 9, "again AND again " * 9]
    rows = [(2 * i, t) for i, t in enumerate(texts)] + [(None, "no id here"), (None, None), (4, "a second text of four")] + [(6, "twice twice")] * 2
    docs = clashing(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = W.edited_likeness(docs).collect()
    by_id = {}
    for i, t in rows:
        by_id.setdefault(i, set()).add(t or "")
    ids = sorted(by_id, key=lambda i: (i is not None, i or 0))
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    prints, hashes = {}, {r["doc_id"]: set() for r in got}
    for i, t in rows:
        follower = ids[(ids.index(i) + 1) % len(ids)]
        q = len(t or "") // 4
        hashes[i] |= {hashlib.sha256(((t or "")[: len(t or "") - q] + n[:q]).encode()).hexdigest() for n in by_id[follower]}
    for r in got:
        assert r["edited_sha256"] in hashes[r["doc_id"]]
        assert len(r["fingerprint"]) == len(r["edited_fingerprint"]) == 4 * W.SAMPLES
        cut = lambda x: [x[i : i + 4] for i in range(0, len(x), 4)]
        assert r["near_edited"] == sum(map(str.__eq__, cut(r["fingerprint"]), cut(r["edited_fingerprint"]))) / W.SAMPLES
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    for r in got:
        follower = ids[(ids.index(r["doc_id"]) + 1) % len(ids)]
        cut = lambda x: [x[i : i + 4] for i in range(0, len(x), 4)]
        assert r["near_next"] in {sum(map(str.__eq__, cut(r["fingerprint"]), cut(p))) / W.SAMPLES for p in prints[follower]}
    at = {t: i for i, t in reversed(rows)}
    assert prints[at["?!"]] == prints[2 * texts.index("?!") + 2] != prints[at[""]]
    assert prints[at[""]] == {"0" * 4 * W.SAMPLES} == prints[0]
    assert W.edited_likeness(docs.limit(0)).count() == 0
    alone = W.edited_likeness(documents(spark, ["all alone here"])).first()
    assert alone["near_next"] == 1
    plain = {(r["doc_id"], r["fingerprint"]) for r in W.with_fingerprints(docs).collect()}
    assert plain == {(r["doc_id"], r["fingerprint"]) for r in got}


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    texts = [r["text"] or "" for r in docs]
    got = {r["doc_id"]: r for r in queries.op11_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    errors = []
    for k, r in enumerate(docs):
        t, n = texts[k], texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + n[:q]
        row = got[r["doc_id"]]
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and row["n_chars"] == len(t)
        for key, other in (("near_edited", edited), ("near_next", n)):
            j = similarity(t, other)
            errors.append((row[key] - j, math.sqrt(j * (1 - j) / W.SAMPLES)))
    off = [e / max(s, 0.005) for e, s in errors]
    assert abs(sum(e for e, _ in errors) / len(errors)) < 0.01
    assert sum(abs(x) > 4 for x in off) <= 0.01 * len(off)


def test_heavier_terms_are_sampled_more(spark):
    rows = [(i, " ".join([f"w{i}x"] * 1 + [f"w{i}y"] * 3), " ".join([f"w{i}x"] * 2 + [f"w{i}y"] * 1)) for i in range(300)]
    texts = spark.createDataFrame(rows, "id bigint, one string, two string")
    got = W.sampled(texts, ["id"], ["one", "two"]).select(W.likeness(W.fingerprint("one_samples"), W.fingerprint("two_samples")).alias("x")).collect()
    assert abs(sum(r["x"] for r in got) / 300 - 2 / 5) < 0.02
