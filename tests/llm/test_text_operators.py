import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chartloom.llm import chat_format as C
from chartloom.llm import decontaminate as D
from chartloom.llm import html_extract as H
from chartloom.llm import span_dedup as P
from chartloom.llm import topk_search as K

from .helpers import DOCS, EDGES, SF, documents


# -- substring dedup ---------------------------------------------------------------------------------------------------
def passage(rng, sentences=6):
    return " ".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.randint(8, 12))).capitalize() + "." for _ in range(sentences))


def plain_sentences(text):
    """(first, last + 1) word numbers and words of the sentences, word by word."""
    words = [m for m in re.finditer(r"[^\s.!?]+[.!?]*|[.!?]+", text)]
    ends = [m[0][-1] in ".!?" or i + 1 == len(words) or "\n" in text[m.end() : words[i + 1].start()] for i, m in enumerate(words)]
    crc, near = [zlib.crc32(m[0].lower().encode()) for m in words], range(1, P.REACH + 1)
    cuts = []
    for i in range(len(words)):
        inside = P.REACH <= i < len(words) - P.REACH
        if ends[i] or inside and all(crc[i] < crc[i - d] and crc[i] <= crc[i + d] for d in near) and not any(ends[i - P.REACH : i + P.REACH]):
            cuts.append(i + 1)
    spans = list(zip([0, *cuts[:-1]], cuts))
    return [(words[a - 1].end() if a else 0, words[b - 1].end()) for a, b in spans], [" ".join(m[0].lower() for m in words[a:b]) for a, b in spans]


def brute_spans(rows, run=3):
    """rows (doc_id, text): by row, the character ranges of sentences that a non-first repeated run covers."""
    first = {}
    for doc, text in rows:
        said = plain_sentences(text or "")[1] if doc is not None else []
        for a in range(len(said) - run + 1):
            key = tuple(said[a : a + run])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, text in rows:
        at, said = plain_sentences(text or "") if doc is not None else ([], [])
        cut, here = set(), set()
        for a in range(len(said) - run + 1):
            key = tuple(said[a : a + run])
            if first[key] < doc or key in here:
                cut |= set(at[a : a + run])
            here.add(key)
        out.append(cut)
    return out


def check_spans(rows, got):
    """got: (doc_id, text, removed_chars) of the result, in any order."""
    want = []
    for (doc, text), cut in zip(rows, brute_spans(rows)):
        left = text
        for s, e in sorted(cut, reverse=True):
            left = left[:s] + " " + left[e:]
        want.append((doc or -1, " ".join((left or "").split()), sum(e - s for s, e in cut)))
    assert sorted((r["doc_id"] or -1, " ".join((r["text"] or "").split()), r["removed_chars"]) for r in got) == sorted(want)


def test_repeated_passages_go_but_the_first(spark):
    rng = random.Random(1)
    shared, own = [passage(rng) for _ in range(3)], [passage(rng, 3) for _ in range(9)]
    texts = [f"{own[0]} {shared[0]} {own[1]}", f"{own[2]}\n{shared[0]}\n{own[3]}", f"{shared[1]} {own[4]} {shared[1]}", own[5], f"{shared[0]} {shared[2]}", f"{own[6]} {shared[2]}", shared[0], *EDGES]
    clashing = documents(spark, texts, extra=True).withColumn("removed_chars", F.lit("own")).withColumn("first_docs", F.lit("own")).withColumn("k", F.lit("own"))
    rows = P.remove_repeated_spans(clashing).collect()
    got = {r["doc_id"]: r for r in rows}
    check_spans(list(enumerate(texts)), rows)
    for i, cut in enumerate(brute_spans(list(enumerate(texts)))):
        if not cut:
            assert got[i]["text"] == texts[i] and got[i]["first_docs"] == []
    assert shared[0] in got[0]["text"] and shared[0] not in got[1]["text"] and own[3] in got[1]["text"] and got[1]["first_docs"] == [0]
    assert got[2]["text"].count(shared[1]) == 1 and got[6]["text"] == "" and got[6]["k"] == "own"
    dropped = P.drop_repeated_spans(clashing)
    assert dropped.columns == clashing.columns
    left = {r["doc_id"]: r for r in dropped.collect()}
    assert set(left) == set(got) - {6} and all(r["removed_chars"] == "own" for r in left.values())
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.values())


def test_three_short_sentences_are_a_span(spark):
    texts = ["Go on now. It is late. Come. One more thing is here.", "Another beginning. Go on now. It is late. Come. Another end."]
    got = {r["doc_id"]: r["text"] for r in P.remove_repeated_spans(documents(spark, texts)).collect()}
    assert got == {0: texts[0], 1: "Another beginning. Another end."}


def test_a_passage_inside_longer_sentences_is_cut_alike(spark):
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    shared = words(80)
    texts = [f"{words(3)} {shared} {words(2)}.", f"{words(60)} {shared} {words(90)}", f"{words(1)}. {shared}."]
    rows = P.remove_repeated_spans(documents(spark, texts)).collect()
    check_spans(list(enumerate(texts)), rows)
    middle = " ".join(shared.split()[25:55])
    assert [middle in r["text"] for r in sorted(rows)] == [True, False, False]


def test_spans_on_a_real_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    from chartloom.llm.queries import op2_span_dedup

    check_spans(rows, op2_span_dedup(spark, SF).collect())


def test_span_dedup_of_rows_that_share_ids(spark):
    rng = random.Random(2)
    p, o = passage(rng), passage(rng)
    rows = [(None, p), (4, p), (4, p), (9, p), (9, o), (9, o + " " + p), (11, o)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_spans(rows, P.remove_repeated_spans(docs).collect())
    kept = sorted((r["doc_id"] or -1, r["text"]) for r in P.remove_repeated_spans(docs).collect())
    assert kept == sorted([(-1, p), (4, p), (4, p), (9, ""), (9, o), (9, o), (11, "")])
    assert P.remove_repeated_spans(docs.limit(0)).count() == 0 and P.drop_repeated_spans(docs.limit(0)).count() == 0


# -- exact top-k -------------------------------------------------------------------------------------------------------
def brute_top(rows, k):
    out = []
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted(((-sum(x * y for x, y in zip(v, w)), i) for i, w in rows if i != q))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "dims", "sparse"), [(90, 7, False), (200, 30, True), (1, 3, False), (5, 4, True)])
def test_top_k_is_exact(spark, n, dims, sparse):
    rng = np.random.default_rng(n)
    rows = [(i, [int(x) if not sparse or rng.random() < 0.2 else 0 for x in rng.integers(-3, 4, dims)]) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id bigint, weights array<bigint>")
    got = K.top_k(df.where("vec_id % 20 = 0"), df, 20, query_block=3, candidate_block=17)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == brute_top(rows, 20)


def test_top_k_of_large_weights_ties_repeats_and_nothing(spark):
    rows = [(0, [3 * 10**9, 1]), (1, [10**9, 7]), (2, [10**9, 7]), (2, [10**9, 7]), (3, [-(10**9), 0])]
    df = spark.createDataFrame(rows, "vec_id bigint, weights array<bigint>")
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in K.top_k(df.where("vec_id = 0"), df, 4).collect())
    best = 3 * 10**18 + 7
    assert got == [(1, 1, best), (2, 2, best), (3, 2, best), (4, 3, -3 * 10**18)]
    assert K.top_k(df.limit(0), df).count() == 0 and K.top_k(df, df.limit(0)).count() == 0


def test_each_query_row_has_a_ranking_of_its_own(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.integers(-9, 9, 6).tolist()) for i in range(1, 60)]
    queries = [(0, [1, 2, 3, 4, 5, 6]), (0, [1, 2, 3, 4, 5, 6]), (0, [-6, 5, -4, 3, -2, 1]), (7, rows[6][1])]
    kind = "vec_id bigint, weights array<bigint>"
    got = K.top_k(spark.createDataFrame(queries, kind), spark.createDataFrame(rows, kind), 20, query_block=2, candidate_block=16).collect()
    want = []
    for q, w in queries:
        best = sorted((-int(np.dot(w, v)), i) for i, v in rows if i != q)[:20]
        want += [(q, r, i, -score) for r, (score, i) in enumerate(best, 1)]
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == 80


def test_top_k_keeps_rows_of_one_id_that_tie(spark):
    rows = [(0, [1, 0])] + [(1, [5, i]) for i in range(30)] + [(2, [4, 0])] * 40 + [(3, [4, 1])]
    df = spark.createDataFrame(rows, "vec_id bigint, weights array<bigint>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in K.top_k(df.where("vec_id = 0"), df, 20, candidate_block=7).orderBy("rank").collect()]
    assert got == [(i, 1, 5) for i in range(1, 21)]
    got = [(r["rank"], r["vec_id"]) for r in K.top_k(df.where("vec_id = 0"), df.where("vec_id <> 1"), 20, candidate_block=7).orderBy("rank").collect()]
    assert got == [(i, 2) for i in range(1, 21)]


def test_vectors_with_gaps_take_no_part(spark):
    df = spark.createDataFrame([(0, [0.5, -0.01]), (20, None), (1, [float("nan"), 1.0]), (2, [None, 1.0]), (3, [float("inf"), 0.0]), (40, [])], "vec_id bigint, embedding array<float>")
    rows = df.where(K.usable(F.col("embedding"))).select("vec_id", K.quantised(F.col("embedding")).alias("weights")).collect()
    assert [(r[0], r[1]) for r in rows] == [(0, [32, -1]), (40, [])]


# -- decontamination ---------------------------------------------------------------------------------------------------
def levenshtein_inside(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern):
            new.append(min(row[i] + (p != c), row[i + 1] + 1, new[i] + 1))
        row, best = new, min(best, new[-1])
    return best


def test_matcher_finds_all_within_the_budget():
    rng = random.Random(7)
    items = tuple((i, "".join(rng.choices("abc de", k=rng.randint(30, 60))).strip()) for i in range(12))
    items = tuple((i, D.normalised(t)) for i, t in items)
    matcher = D.ItemMatcher(items, 0.1)
    for _ in range(60):
        i, t = rng.choice(items)
        edited = list(t)
        for _ in range(rng.randint(0, 8)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        text = D.normalised("".join(rng.choices("abc de", k=80)) + "".join(edited) + "".join(rng.choices("abc de", k=80)))
        want = {n: d for n, s in items if (d := levenshtein_inside(s, text)) <= D.budget(len(s), 0.1)}
        assert {n: d for n, d, _ in matcher.matches(text)} == want


def test_short_items_have_a_budget_too(spark):
    bench = spark.createDataFrame([(1, "eighteen signs set")], "item_id bigint, text string")
    got = [(r["doc_id"], r["distance"]) for r in D.contaminated(documents(spark, ["an eighteen sings set", "an eighteen signs xet", "nothing"]), bench).collect()]
    assert got == [(1, 1)]


def test_contamination_of_odd_tables_and_blocks(spark):
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, "  "), (None, item), (4, "tiny item")], "item_id bigint, text string")
    texts = [f"Well: {item.upper().replace(' ', '  ')}.", item.replace("quick", "quack"), "clean", f"a tiny  item and {item[:30]}", *EDGES]
    docs = documents(spark, texts, extra=True)
    want = [(0, 1, 0), (1, 1, 1), (3, 4, 0)]
    for block in (10, 10**6):
        got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in D.contaminated(docs, bench, block_chars=block).collect())
        assert got == want
    assert {r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()} == set(range(2, len(texts))) - {3}
    assert D.contaminated(docs, bench.limit(0)).count() == 0 and D.contaminated(docs.limit(0), bench).count() == 0


def test_op7_against_plain_search(spark):
    from chartloom.llm.queries import op7_decontaminate

    docs = [(r["doc_id"], D.normalised(r["text"])) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], D.normalised(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    exact = {(d, i) for (d, t), (i, s) in itertools.product(docs, items) if s in t}
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in op7_decontaminate(spark, SF).collect()}
    assert exact == {k for k, d in got.items() if d == 0}


# -- HTML --------------------------------------------------------------------------------------------------------------
PAGES = [
    ("<article><header><h1>T</h1></header><p>a &amp; b<br>c<p>d <b>e</b>&nbsp;f</article><footer>x</footer>", "T\n\na & b c\n\nd e f"),
    ("<html><body><nav>m</nav><div class='side-bar sidebar'>s</div><div><h2>H</h2><ul><li>one<li>two</ul></div><form>q<input></form></body></html>", "H\n\none\n\ntwo"),
    ("<main>x<script>var t='</p>';</script><style>p{}</style><section id=comments><p>c</p></section> y</main>", "x\n\ny"),
    ("<article>cut off <p>mid", "cut off\n\nmid"),
    ("<article><div class=ad>no</div><table><tr><td>1<td>2<tr><td>3</table></article>", "1\n\n2\n\n3"),
    ("plain &lt;text&gt; <!-- gone --> here", "plain <text> here"),
    ("<article><p>a</p><article class='comment'><p>b</p></article></article>", "a"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    (None, ""),
    ("", ""),
    ("<div><br/></div>", ""),
]


@pytest.mark.parametrize(("page", "want"), PAGES)
def test_main_text(page, want):
    assert H.main_text(*H.blocks_of(H.parse(page or ""))) == want


def test_templates_of_a_host_go_without_telling_markup(spark):
    rows = [(i, f"https://A.example.org:80/{i}", f"<body><div><p>Our site menu</p><p>Second line</p></div><div><p>Story {i} is here</p></div><div><p>Contact us</p></div></body>") for i in range(8)]
    rows += [(100, "https://b.example.org/", "<body><div><p>Contact us</p></div><p>other</p></body>"), (101, None, None), (102, "no url", "<p>z</p>"), (7, rows[7][1], rows[7][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("own")).withColumn("hash", F.lit(1))
    for held in (10**6, 0):
        got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.extract(pages, held=held).collect())
        story = [(i, f"Story {i} is here", 15) for i in range(8)]
        assert got == sorted([*story, story[7], (100, "Contact us\n\nother", 17), (101, "", 0), (102, "z", 1)])
    assert H.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "inner",
    ['<section id="search-algorithms">', '<h2 id="social-history">', '<section class="related-work">', '<p class="ad-hoc">', '<section id="notice-of-appeal">', '<div class="figure share-price-table">', '<p id="comments">', "<math>"],
)
def test_headings_and_topics_within_articles_stay(inner):
    tag = inner.strip("<>").split()[0]
    page = f"<body><div id='search-box'>find</div><article><p>before</p>{inner}kept words</{tag}><p>after</p><p class='x share'>share this</p><div class='comments'>reader</div></article></body>"
    assert " ".join(H.main_text(*H.blocks_of(H.parse(page))).split()) == "before kept words after"


def test_recurring_parts_of_articles_go_by_the_counts_alone(spark, monkeypatch):
    rng = random.Random(4)
    stories = [[passage(rng, 2) for _ in range(3)] for _ in range(12)]
    extra = "<div><p>Read more of our best stories</p><p>Follow us</p></div>"
    rows = [(i, "https://c.example.org/", f"<article><h1>Story {i}</h1><p>{a}</p>{extra}<p>{b}</p><section><p>{c}</p><p>By our desk</p></section></article>") for i, (a, b, c) in enumerate(stories)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    want = {(i, "\n\n".join((f"Story {i}", a, b, c))) for i, (a, b, c) in enumerate(stories)}
    for held in (10**6, 0):
        assert {(r["page_id"], r["text"]) for r in H.extract(pages, held=held).collect()} == want
    none = spark.createDataFrame([], "host string, hash bigint")
    monkeypatch.setattr(H, "_templates", lambda *a: none)
    assert all("Follow us" in r["text"] and "By our desk" in r["text"] for r in H.extract(pages).collect())


def test_an_article_that_a_site_repeats_stays(spark):
    body = "<article><h1>Terms</h1><p>One</p><p>Two</p></article>"
    rows = [(i, "https://d.example.org/", body) for i in range(9)] + [(9, "https://d.example.org/", "<article><p>Other</p></article>")]
    rows += [(20 + i, "https://e.example.org/", f"<nav>{i}</nav>{body}<footer>{i}</footer>") for i in range(9)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got.pop(9) == "Other" and set(got.values()) == {"Terms\n\nOne\n\nTwo"}


def test_a_page_of_templates_alone_is_empty(spark):
    menu = "<div><p>Menu of the site</p></div>"
    rows = [(i, "https://f.example.org/", f"<body>{menu}<p>Story {i}</p></body>") for i in range(8)] + [(9, "https://f.example.org/", f"<body>{menu}</body>")]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {**{i: f"Story {i}" for i in range(8)}, 9: ""}


def brute_extract(rows, least_pages, least_share):
    """Template removal of a small table by plain counting, with the parser of the operator."""
    parsed = {i: H.blocks_of(H.parse(page or ""))[0] for i, (_, _, page) in enumerate(rows)}
    host = [re.sub(r"^\w+://([^/:?#]*).*", r"\1", url or "", flags=re.DOTALL).lower() if "://" in (url or "") else "" for _, url, _ in rows]
    out = []
    for i, (page_id, _, _) in enumerate(rows):
        same = {tuple(t for t, _ in parsed[j]): {h for _, c in parsed[j] for h in c} for j in parsed if host[j] == host[i]}
        on = lambda h: sum(h in hashes for hashes in same.values())  # noqa: E731, B023
        many = {h for _, c in parsed[i] for h in c if on(h) >= least_pages and on(h) >= least_share * len(same)}
        left = [t for t, c in parsed[i] if not many & set(c)] or ([t for t, _ in parsed[i]] if "<article" in (rows[i][2] or "") else [])
        out.append((page_id, "\n\n".join(left)))
    return sorted(out)


def test_op6_against_brute_force(spark):
    from chartloom.llm.queries import op6_html

    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    assert sorted((r["page_id"], r["text"]) for r in op6_html(spark, SF).collect()) == brute_extract(rows, 5, 0.3)
    rng = random.Random(6)
    bits = [f"<p>{passage(rng, 1)}</p>" for _ in range(12)]
    rows = [(i, f"https://h{i % 3}.example.org/{i}", "<body>" + "".join(f"<div>{''.join(rng.sample(bits, 2))}</div>" if rng.random() < 0.5 else rng.choice(bits) for _ in range(6)) + "</body>") for i in range(60)]
    got = H.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string"), 3, 0.25)
    assert sorted((r["page_id"], r["text"]) for r in got.collect()) == brute_extract(rows, 3, 0.25)


# -- chat --------------------------------------------------------------------------------------------------------------
def test_chat_round_trip_of_hostile_texts(spark):
    texts = [None, "", "\\", "\\l\\b<|end|>", "<|turn|>user<|text|>", "</s>[INST] ok [/INST]", "\n", "😀[<\\", "x" * 10_000]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, None, "only"), (None, None, "user", "lost"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, 1, "assistant", "tie")]
    m = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts"), F.lit(1).alias("at"), F.lit(2).alias("first"))
    out = C.format_conversations(m).withColumn("turns", C.turns_read_back(F.col("formatted"))).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("assistant" if i % 2 else "user", t or "") for i, t in enumerate(texts)]
    assert got[1]["loss"] == "".join(t or "" for i, t in enumerate(texts) if i % 2)
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "only")] and got[None]["n_turns"] == 1
    assert [t["role"] for t in got[3]["turns"]] == ["assistant", "user", "user"] and got[3]["n_turns"] == 3
    assert C.format_conversations(m.limit(0)).count() == 0


def test_typed_parts_become_placeholders(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    rows = [
        (1, 0, "user", [part("text", "see <"), part("image", ref="a.png", units=2), part("document", ref="b.pdf")]),
        (1, 1, "assistant", [part("text", "one"), part("audio", ref="c.wav", units=3), part("text", "two"), part("other", "raw")]),
        (1, 2, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{C.PART}>")
    r = C.format_conversations(df).withColumn("loss", C.loss_text(F.col("formatted"), F.col("loss_spans"))).first()
    assert r["formatted"] == "<|turn|>user<|text|>see \\l<|image:0|><|document:1|><|end|><|turn|>assistant<|text|>one<|audio:2|>tworaw<|end|><|turn|>user<|text|><|end|>"
    assert [(a["n"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 1152), (1, "document", "b.pdf", 800), (2, "audio", "c.wav", 150)]
    assert r["expanded_tokens"] == 2102 and r["loss"] == "onetworaw"


def test_op1_digests(spark):
    from chartloom.llm.queries import op1_chat_format

    want = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    df = op1_chat_format(spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    for r in df.collect():
        turns = want.pop(r["conv_id"])
        said = "".join(t for role, t in turns if role == "assistant")
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(said), hashlib.sha256(said.encode()).hexdigest())
    assert not want


def test_documents_schema():
    assert DOCS.startswith("doc_id bigint")


def test_op2_returns_every_row(spark):
    from chartloom.llm.queries import op2_span_dedup

    rows = op2_span_dedup(spark, SF).select("doc_id", "removed_chars").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count() and any(r["removed_chars"] == 0 for r in rows)
