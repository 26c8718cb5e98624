"""The corpus operators against brute force, exact round trips and held-out accuracy; null, empty, long, tied and clashing input."""

import hashlib
import html
import math
import random
import zlib

import numpy as np
import pytest

from veriflume.llm import bin_slack, common, decontaminate, group_join, itq_dedup, language_kernel, line_dedup, queries, radix_dedup, style_tree, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, size int, at int, name string, data binary, __id long"


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def clashing(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "n", b"d", 3) for i, t in enumerate(texts)], EXTRA)


def prose(rng, n, words=60):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


# ---------------------------------------------------------------- shared

def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (5, 5)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame([*edges, (None, 1)], "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rolling_hash():
    buf = np.frombuffer(b"abcabcabdabc", np.uint8)
    roll = common.Rolling(buf)
    h = roll.of(np.arange(10), np.arange(10) + 3)
    assert h[0] == h[3] == h[9] and h[6] != h[0] and len(set(h.tolist())) == 6


# ---------------------------------------------------------------- 1 style tree

PAGE = "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><nav><ul><li>Menu</li></ul></nav><div class='ad'>Buy</div><article><h1>Head&amp;line</h1><p>One  <b>two</b>\n three<br>four<p>Next &lt;x&gt;<div class='comments'><p>Reader says</p></div></article><aside>Side</aside><footer>Foot</footer></body></html>"


def alone(spark, *pages):
    """The main text of pages of one host each."""
    df = spark.createDataFrame([(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return [r["text"].split("\n\n") if r["text"] else [] for r in style_tree.extract(df).orderBy("page_id").collect()]


def test_style_tree_page(spark):
    pages = [PAGE, "", None, "plain & simple", "<p>a<!-- <p>no</p> -->b", "<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "".join(f"<p>x{i}" for i in range(5000)), "<p>one <span class=ad>no</span> two<main></main>", "<p>a " + "word " * 300_000]
    got = alone(spark, *pages)
    assert got[0] == ["Head&line", "One two three four", "Next <x>"]
    assert got[1:6] == [[], [], ["plain & simple"], ["ab"], ["a", "b", "c", "d"]] and len(got[6]) == 5000
    assert got[7] == ["one two"] and len(got[8][0]) == 1_500_001
    everything = style_tree.main_blocks(PAGE, set())  # without the tree nothing but scripts and styles goes
    assert {"Menu", "Buy", "Side", "Foot", "Reader says", "Head&line"} <= set(everything) and not any("no" in t for t in everything)


def brute_importance(pages):
    """{(host, path): (importance, seen)} and, of furniture's last steps over all hosts, {step: (importance, seen)}, by loops over the parsed pages."""
    from collections import Counter

    features, steps = {}, {}
    for url, page in set(pages):  # copies of a page are one page, and given urls differ
        blocks, nodes = style_tree.parse(page)
        for kind, found in ((0, nodes), (1, blocks)):
            for path, x in found:
                features.setdefault((url_filter.split_url(url)[0], path, kind), Counter())[x] += 1
                if "!" in path:
                    steps.setdefault(("", path.split(">")[-1], kind), Counter())[x] += 1

    def entropies(features):
        own = {}
        for k, c in features.items():
            m = sum(c.values())
            if m == 1:
                own[k] = 1.0
            elif k[2] == 0:
                own[k] = -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m)
            else:
                own[k] = 1 - sum(math.log(n) for n in c.values()) / len(c) / math.log(m)
        return own

    def whole(features, own, below):
        out = {}
        for (host, path, kind), v in own.items():
            if kind == 0:
                m = sum(features[host, path, kind].values())
                leaves = [(sum(features[k].values()), own[k]) for k in own if k[2] == 1 and k[0] == host and below(k[1], path)]
                out[host, path] = (0.1 * v + 0.9 * sum(n * x for n, x in leaves) / sum(n for n, _ in leaves) if leaves else v, m)
        return out

    nodes = whole(features, entropies(features), lambda leaf, path: leaf == path or leaf.startswith(path + ">"))
    return nodes, whole(steps, entropies(steps), lambda leaf, path: leaf == path)


def test_style_tree_importance_against_loops(spark):
    d = "/root/testdata/sf0.001"
    pages = [(r["url"], r["html"]) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    pages += [(f"http://t.example/{i}", f"<body><div>Notice</div><div class=x{i % 3}><p>{i} own</p></div>{'<main>m</main>' if i % 2 else ''}</body>") for i in range(12)]
    pages += [pages[3]] * 9
    got = style_tree.statistics(spark.createDataFrame(pages, "url string, html string")).collect()
    want, steps = brute_importance(pages)
    assert {(r["host"], r["path"]) for r in got} == want.keys() and steps
    for r in got:
        v, m = want[r["host"], r["path"]]
        assert abs(r["importance"] - v) < 1e-9 and abs(r["seen"] - m) < 1e-9
        step = steps.get(("", r["path"].split(">")[-1])) if r["prior"] < 0 else None
        assert (r["step_seen"] is None) == (step is None) and (step is None or abs(r["step_importance"] - step[0]) < 1e-9 and abs(r["step_seen"] - step[1]) < 1e-9)


def test_style_tree_entropies_decide_for_every_prior(spark):
    """The given pages on one host, with a notice inside the article that is the same everywhere, furniture whose text and
    structure never repeat, and furniture that is regular: only their entropies tell them apart."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    rng = random.Random(1)

    def page(i, html_, notice, links):
        odd = "".join(f"<{rng.choice(['p', 'b', 'ul', 'i', 'h2'])}>{prose(rng, 9, 10**6)}</{rng.choice(['p', 'b'])}>" for _ in range(rng.randint(5, 12))) if links else "<ul><li>Home</li><li>About</li></ul>"
        return html_.replace("</h1>", f"</h1><div class='box'>{notice}</div>").replace("<footer>", f"<aside>{odd}</aside><footer>")

    def texts(notice, links):
        pages = spark.createDataFrame([(r["page_id"], f"http://one.example/{i}", page(i, r["html"], notice(i), links)) for i, r in enumerate(rows)], "page_id long, url string, html string")
        return {r["page_id"]: r["text"].split("\n\n") for r in style_tree.extract(pages).collect()}

    plain = {r["page_id"]: r["text"].split("\n\n") for r in queries.op1_style_tree(spark, "/root/testdata/sf0.01").collect()}
    same, own = texts(lambda i: "All rights are ours", False), texts(lambda i: f"Own words {i}", True)
    assert same == plain  # a landmark's branch goes, furniture goes
    for i, r in enumerate(rows):
        assert f"Own words {i}" in own[r["page_id"]] and len(own[r["page_id"]]) > len(plain[r["page_id"]]) + 1  # both stay, by their entropies alone
    assert all("Home" not in t for t in own.values())
    flat = style_tree.extract(spark.createDataFrame([(r["page_id"], f"http://one.example/{i}", page(i, r["html"], "All rights are ours", False)) for i, r in enumerate(rows)], "page_id long, url string, html string"), {-1: -1.0, 0: -1.0, 1: -1.0})
    assert all("All rights are ours" in r["text"] and "Home" in r["text"] for r in flat.collect())  # nothing else removes them


def test_style_tree_without_evidence_leaves_priors(spark):
    pages = [(i, f"http://h{i % 3}.example/{i}", f"<body><nav><a>{prose(random.Random(i), 5, 999)}</a></nav><article><p>The same words</p></article></body>") for i in range(6)]
    got = style_tree.extract(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {"The same words"}
    copies = [(i, "http://one.example/", pages[0][2]) for i in range(50)]  # fifty copies are one page
    assert {r["text"] for r in style_tree.extract(spark.createDataFrame(copies, "page_id long, url string, html string")).collect()} == {"The same words"}


def test_style_tree_without_landmarks(spark):
    """Sample pages of one host whose article is a nameless div, with a notice that only its repetition gives away."""
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/pages.parquet").orderBy("page_id").collect()
    plain = [(r["page_id"], f"http://one.example/{i}", r["html"].replace("<article>", "<div><p>The same words everywhere</p></div><section>").replace("</article>", "</section>")) for i, r in enumerate(rows)]
    want = {r["page_id"]: r["text"] for r in queries.op1_style_tree(spark, d).collect()}
    got = {r["page_id"]: r["text"] for r in style_tree.extract(spark.createDataFrame(plain, "page_id long, url string, html string")).collect()}
    assert len(rows) > 20 and got == want


def test_style_tree_learns_a_template(spark):
    rng = random.Random(0)
    rows = [(i, f"http://one.example/{i}", f"<body><div><p>Same notice on every page</p></div><section><p>{html.escape(prose(rng, 20, 9999))}</p></section></body>") for i in range(20)]
    rows += [(100, None, None), (101, "nonsense", ""), (100, None, None), (102, "http://two.example/", "<body><div><p>Alone</p></div></body>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS path", "3 AS text")
    got = sorted(map(tuple, style_tree.extract(pages).collect()), key=lambda r: r[0])
    assert len(got) == 24 and all("notice" not in r[2] and r[3] == len(r[2]) > 0 for r in got[:20])
    assert [r[2] for r in got[20:]] == ["", "", "", "Alone"]
    assert sorted(map(tuple, style_tree.extract(pages, broadcast_rows=0).collect()), key=lambda r: r[0]) == got
    assert style_tree.extract(pages.where("false")).count() == 0


def test_style_tree_joins_without_page_ids(spark):
    rng = random.Random(1)
    body = lambda rare, often: f"<body><div><p>{often}</p></div><section><p>{rare}</p></section></body>"
    one = [(None if i % 2 else i, f"http://one.example/{i}", body(prose(rng, 20, 9999), "Same notice")) for i in range(20)]
    two = [(i, f"http://two.example/{i}", body("Same notice", prose(rng, 20, 9999))) for i in range(20)]  # page_ids of the first host again
    pages = spark.createDataFrame([*one, *two, (None, None, None), (None, None, body("a", "b"))], "page_id long, url string, html string")
    order = lambda rows: sorted(map(tuple, rows), key=str)
    want = order(style_tree.extract(pages).collect())
    assert sum(r[3] > 0 for r in want) == 41 and all("notice" not in r[2] for r in want)
    assert order(style_tree.extract(pages, broadcast_rows=0).collect()) == want


def test_style_tree_on_whole_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r["page_id"]: r["text"] for r in queries.op1_style_tree(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        import re

        want = [" ".join(html.unescape(re.sub("<(?!p>|/p>|/?h1>)[^>]*>", " ", b)).split()) for b in re.split("</?p>|</?h1>", body)]
        assert got[r["page_id"]] == "\n\n".join(b for b in want if b)


# ---------------------------------------------------------------- 2 url automaton

def test_automaton_against_matching():
    import fnmatch

    rng = random.Random(2)
    globs = ["".join(rng.choice("ab*") for _ in range(rng.randint(1, 40))) for _ in range(60)]
    globs = [g for g in globs if g.strip("*")]
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(200)]
    got = url_filter.Automaton([g.encode() for g in globs]).match([t.encode() for t in texts])
    assert url_filter.Automaton([g.encode() for g in globs]).words > 5
    for i, t in enumerate(texts):
        for j, g in enumerate(globs):
            assert got[i, j] == fnmatch.fnmatchcase(t, g), (t, g)


def test_url_rules(spark):
    cases = [("http://a.example.net/en/x", "example.net/en/", "allow"), ("http://example.NET/fr", "net/", "block"), ("https://x.org/fr/?q", "org/fr/", "allow"), ("http://notexample.com/de/", None, "allow"), ("http://example.com/de/", "example.com/de/", "block"),
             ("http://net", None, "allow"), ("no scheme", None, "allow"), (None, None, "allow"), ("", None, "allow"), ("http://a.net/" + "x" * 100_000, "net/", "block"), ("http://a.net#/x", None, "allow"), ("http://ÄB.net/é", "net/", "block")]
    pages = spark.createDataFrame([(i, u, "x") for i, (u, _, _) in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in enumerate(cases)}


# ---------------------------------------------------------------- 3 toxicity

def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = [r for r in queries.op3_toxicity(spark, d).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    pos = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 1]
    neg = [r["score"] for r in got if r["held_out"] and labels.get(r["doc_id"]) == 0]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.93
    assert len(got) == 10_000


def test_toxicity_without_gold(spark):
    """Seeds and patterns alone, which owe nothing to the labels; texts whose toxic words are invented stay out of their reach."""
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = [(r["score"], truth[r["doc_id"]]) for r in toxicity.judge(docs, labels.where("false")).collect() if r["held_out"] and r["doc_id"] in truth and lang[r["doc_id"]] == "en"]
    pos, neg = [s for s, y in got if y], [s for s, y in got if not y]
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > 0.9


def test_toxicity_patterns():
    voters = toxicity.Voters(toxicity.SEEDS)
    flags = lambda t: voters.of(t)[1][[5, 6, 7]].tolist()
    assert flags("YOU THERE STOP DOING ALL THAT") == [1, 0, 0] and flags("stop!! now") == [0, 1, 0] and flags("what a f**k, s#it") == [0, 0, 1]
    assert flags(None) == flags("") == flags("a fine day. A b2b @home") == [0, 0, 0]
    assert voters.of("Idiots are idiotic")[1][0] == np.float32(math.log1p(2)) and voters.of("x " * 1_000_000)[1][3] == 1


def test_toxicity_without_documents_or_classes(spark):
    docs = clashing(spark, ["awful", "fine", None])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    far = spark.createDataFrame([(i, i % 2) for i in range(1000, 1040)], "doc_id long, toxic int")
    assert toxicity.judge(docs.where("false"), labels).count() == 0 and toxicity.drop_toxic(docs.where("false"), labels).count() == 0
    assert {r["score"] for r in toxicity.judge(docs, far).collect()} == {0.0} and toxicity.drop_toxic(docs, far).columns == docs.columns
    assert {r["score"] for r in toxicity.judge(docs, labels.where("toxic = 1")).collect()} == {0.0}
    one = toxicity.judge(docs.where("doc_id = 1"), labels)  # labels of both classes, documents of one
    assert [r["score"] for r in one.collect()] == [0.0]
    long = clashing(spark, [("awful " if i % 2 else "fine ") * (200_000 if i < 2 else 3) for i in range(60)])
    got = {r["doc_id"]: r["score"] for r in toxicity.judge(long, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")).collect()}
    assert got[1] > 0.5 > got[0] and got[3] == got[5] and toxicity.drop_toxic(long, labels).columns == long.columns


def test_toxicity_odd_rows(spark):
    docs = docs_of(spark, [None, "", "x", "x"], [1, 2, 3, 3])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.judge(docs, none).collect()] == [0.0] * 4
    assert toxicity.judge(docs.where("false"), none).count() == 0
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    many = docs_of(spark, ["fine words here" if i % 2 == 0 else "awful words here" for i in range(40)])
    assert toxicity.judge(many, labels).count() == 40 and toxicity.drop_toxic(many, labels).columns == many.columns


def test_label_model_finds_the_good_voter():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(y, rng.random(4000) < 0.9, rng.random(4000) < 0.02), rng.random(4000) < 0.3, rng.random(4000) < 0.3], 1).astype(np.float32)
    votes[:, 2] = votes[:, 1]  # a copied voter
    q, rate, weight = toxicity.label_model(votes, (y ^ (rng.random(4000) < 0.05)).astype(float))
    assert ((q > 0.5) == y).mean() > 0.95 and rate[0, 1] > 0.8 > rate[0, 0] and weight[1] < 0.6 < weight[0]


def test_label_model_against_a_loop():
    """Expectation and maximisation row by row, voter by voter, on few rows; some without a gold vote."""
    rng = random.Random(5)
    n, k = 40, 3
    y = [rng.random() < 0.4 for _ in range(n)]
    votes = [[int(rng.random() < (0.8 if y[i] else 0.1)), int(rng.random() < 0.5), int(rng.random() < (0.6 if y[i] else 0.3))] for i in range(n)]
    gold = [None if i % 3 == 0 else int(y[i]) for i in range(n)]
    start = [v[0] == 1 for v in votes]
    q = [0.9 if (g if g is not None else s) else 0.05 for g, s in zip(gold, start)]
    weight = [1.0] * k
    for turn in range(toxicity.ROUNDS):
        prior = {}
        for told in (True, False):
            mine = [q[i] for i in range(n) if (gold[i] is not None) == told]
            prior[told] = (sum(mine) + 1) / (len(mine) + 2)
        rate = [[(sum(r[i] * votes[i][j] for i in range(n)) + 0.5) / (sum(r) + 1) for r in ([1 - x for x in q], q)] for j in range(k)]
        gs = [i for i in range(n) if gold[i] is not None]
        grate = [(sum(r(i) * gold[i] for i in gs) + 0.5) / (sum(r(i) for i in gs) + 1) for r in (lambda i: 1 - q[i], lambda i: q[i])]
        if turn % 4 == 2:
            left = [[votes[i][j] - (q[i] * rate[j][1] + (1 - q[i]) * rate[j][0]) for j in range(k)] for i in range(n)]
            cov = [[sum(r[a] * r[b] for r in left) / n for b in range(k)] for a in range(k)]
            weight = [1 / max(1, sum(max(cov[a][b] / math.sqrt(cov[a][a] * cov[b][b]), 0) for b in range(k))) for a in range(k)]
        new = []
        for i in range(n):
            p = prior[gold[i] is not None]
            z = math.log(p / (1 - p))
            for j in range(k):
                z += weight[j] * (math.log(rate[j][1] / rate[j][0]) if votes[i][j] else math.log((1 - rate[j][1]) / (1 - rate[j][0])))
            if gold[i] is not None:
                z += math.log(grate[1] / grate[0]) if gold[i] else math.log((1 - grate[1]) / (1 - grate[0]))
            new.append(1 / (1 + math.exp(-z)))
        q = new
    got, rates, weights = toxicity.label_model(np.array(votes, np.float32), np.array([np.nan if g is None else g for g in gold]), np.array(start))
    assert np.allclose(got, q, atol=1e-4) and np.allclose(rates, rate, atol=1e-5) and np.allclose(weights, weight, atol=1e-5)


# ---------------------------------------------------------------- 4 lines

def brute_lines(texts, min_words=8):
    """Every run of any number of lines, by its words: all copies but the first lose all their lines."""
    squeeze = lambda x: " ".join(x.replace("\t", " ").replace("\r", " ").split(" ")).strip()
    lines = [[x for x in (" ".join(squeeze(y).split()) for y in (t or "").split("\n")) if x] for t in texts]
    first, dead = {}, [set() for _ in texts]
    for d, ls in enumerate(lines):
        for i in range(len(ls)):
            for j in range(i + 1, len(ls) + 1):
                if sum(len(x.split(" ")) for x in ls[i:j]) >= min_words and first.setdefault(tuple(ls[i:j]), (d, i)) != (d, i):
                    dead[d] |= set(range(i, j))
    return lines, dead


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["a b c d e f g h", "one two", "x", "three words here", "Another long line of well over eight words indeed", "", "  one   two\t", "y\r"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(60)] + [None, "", "\n\n", "x\n" * 400]
    lines, dead = brute_lines(texts)
    got = {r["doc_id"]: r for r in line_dedup.dedup(clashing(spark, texts), detail=True).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_lines"], r["n_removed"]) == (len(lines[i]), len(dead[i])), t
        assert r["n_runs"] == sum(p - 1 not in dead[i] for p in dead[i])
        n, kept = -1, []
        for x in (t or "").split("\n"):
            n += bool(x.strip())
            if not x.strip() or n not in dead[i]:
                kept.append(x)
        assert r["text"] == (t if not dead[i] else "\n".join(kept))


def test_line_dedup_keeps_rows_and_columns(spark):
    docs = docs_of(spark, ["same line of more than eight words in it\nrest", "same line of more than eight words in it\nother", None, "t"], [5, 6, None, 7])
    out = line_dedup.dedup(docs.unionByName(docs))
    assert out.columns == docs.columns and out.count() == 8
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()} >= {(5, "same line of more than eight words in it\nrest", 45), (6, "other", 5)}
    assert line_dedup.dedup(docs.where("false")).count() == 0
    copies = docs_of(spark, ["same line of more than eight words in it\n", "same line of more than eight words in it\n\n", "", None])
    assert sorted(r["doc_id"] for r in line_dedup.dedup(copies, drop_emptied=True).collect()) == [0, 2, 3] and line_dedup.dedup(copies).count() == 4


@pytest.mark.parametrize("min_words", [1, 5, 8, 12])
def test_line_runs_of_any_size(spark, min_words):
    rng = random.Random(3)
    pool = ["a b c d e f g h", "one two", "x", "three words here", "y z", "five words are in here", "q"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 30))) for _ in range(50)] + [None, "", "x\n" * 40]
    run = ["red fish swim in water", "two lines", "blue birds fly over hills"]  # 5, 2 and 5 words
    long = ["a1 b1 c1", "a2 b2 c2", " ".join(f"k{i}" for i in range(50))]  # 3, 3 and 50 words
    many = [f"s{i}" for i in range(30)]  # a run of thirty words
    texts += ["\n".join(run), "\n".join([*run, "u v"]), "\n".join(["s t", *run, "w"]), "\n".join(["m", *long, "n"]), "\n".join(["o", *long, "p"]), "\n".join(["m2", *many, "n2"]), "\n\n".join(["o2", *many, "p2"])]
    texts += ["\n".join(["m3", *long[::-1]]), "\n".join([*long[::-1], "o3"])]
    lines, dead = brute_lines(texts, min_words)
    if min_words == 8:
        assert dead[-8:] == [{0, 1, 2}, {1, 2, 3}, set(), {1, 2, 3}, set(), set(range(1, 31)), {1}, {0, 1, 2}]
    got = {r["doc_id"]: (r["n_removed"], r["n_runs"], [x for x in (r["text"] or "").split("\n") if x]) for r in line_dedup.dedup(docs_of(spark, texts), min_words, detail=True).collect()}
    assert got == {d: (len(p), sum(i - 1 not in p for i in p), [x for i, x in enumerate(lines[d]) if i not in p]) for d, p in enumerate(dead)}


def test_line_ranks_follow_the_suffix_array(spark):
    """Ranks of doubled pairs sort as the pairs do, across partitions, and only repeated ones have any."""
    rng = random.Random(8)
    rows = [(d, 0, at, rng.randint(0, 20), rng.randint(0, 20)) for d in range(40) for at in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, t long, at int, x long, y long").repartition(7)
    got = line_dedup.ranked(df, "x", "y").orderBy("rank").collect()
    often = {}
    for d, t, at, x, y in rows:
        often.setdefault((x, y), []).append((d, t, at))
    assert [(r["x"], r["y"]) for r in got] == sorted(k for k, v in often.items() if len(v) > 1)
    assert all(tuple(r["first"]) == min(often[r["x"], r["y"]]) for r in got)


def test_line_dedup_of_megabyte_texts(spark):
    text = "\n".join(f"line {i % 7000} has a few words" if i % 3 else "s" for i in range(60_000))
    out = {r["doc_id"]: r for r in line_dedup.dedup(docs_of(spark, [text, text, "w " * 700_000]), detail=True).collect()}
    assert out[1]["text"] == "" and out[1]["n_removed"] == 60_000 and out[1]["n_runs"] == 1 and len(out[2]["text"]) == 1_400_000
    lines = text.split("\n")
    seen, dead = set(), set()
    for k in range(1, 9):
        for i in range(len(lines) - k + 1):
            key = "\n".join(lines[i : i + k])
            if len(key.split()) >= 8:
                if key in seen:
                    dead |= set(range(i, i + k))
                seen.add(key)
    assert out[0]["n_removed"] == len(dead) > 30_000


def test_pipeline_removes_runs_of_three_lines(spark):
    import corpus_pipeline

    run = ["red fish swim in water", "two lines", "blue birds fly over hills"]
    docs = docs_of(spark, ["\n".join(["m", *run]), "\n".join(run), "\n".join([*run, "n"])])
    got = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "").collect()}
    assert got == {0: "\n".join(["m", *run]), 2: "n"}


# ---------------------------------------------------------------- 5 embeddings

def test_itq_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((40, 32))
    rows = [(i, (base[i % 40] + rng.standard_normal(32) * rng.choice([0.02, 0.2, 0.35])).astype(np.float32), int(i % 40 % 3)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(700)]  # copies
    odd = [(5000, None, 1), (5001, [0.0] * 32, 1), (5002, [float("nan")] * 32, 1), (5003, [1.0, None] * 16, 1), (5004, [1.0, 2.0], 1), (5005, rows[0][1].tolist(), None), (5006, [float("inf")] * 32, 1), (5007, [], 1)]
    df = spark.createDataFrame([(i, v.tolist(), c, "k") for i, v, c in rows] + [(*o, "k") for o in odd], "vec_id long, embedding array<float>, label int, key string")
    got = {r["vec_id"]: r for r in itq_dedup.dedup(df).collect()}
    x = np.array([v for _, v, _ in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab, ids = np.array([c for *_, c in rows]), [i for i, *_ in rows]
    near = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(near, False)
    want = near.sum(1)
    have = np.array([got[i]["n_links"] for i in ids])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i, *_ in odd)
    assert got[1000]["component_id"] == got[0]["component_id"] == 0 and len(got) == len(rows) + len(odd)
    assert itq_dedup.dedup(df.where("false")).count() == 0


def test_itq_recall_on_a_larger_table(spark):
    """Against all pairs of sf0.1; the query's counts never exceed them."""
    d = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{d}/embeddings.parquet").collect()
    got = {r["vec_id"]: r["n_links"] for r in queries.op5_itq_dedup(spark, d).collect()}
    want = {}
    for label in {r["label"] for r in rows} - {None}:
        mine = [r for r in rows if r["label"] == label and r["embedding"]]
        x = np.array([r["embedding"] for r in mine], float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        near = x @ x.T >= 0.93
        np.fill_diagonal(near, False)
        want |= {r["vec_id"]: int(n) for r, n in zip(mine, near.sum(1))}
    assert all(got[k] <= n for k, n in want.items()) and sum(got.values()) >= 0.97 * sum(want.values())


def test_what_goes_through_the_tables_is_small():
    assert itq_dedup.sent(1_000, 64) < 300 and itq_dedup.sent(10**6, 64) < 1_000 and itq_dedup.sent(10**8, 64) < 2_500


def test_hamming_candidates():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**63, (30, 2), dtype=np.uint64)
    bits = np.unpackbits(codes.view(np.uint8).reshape(30, -1), axis=1).astype(int)
    assert (itq_dedup.hamming(codes) == (bits[:, None, :] != bits[None, :, :]).sum(2)).all()
    assert itq_dedup.radius_of(64) == 19 and itq_dedup.radius_of(4) == 4


# ---------------------------------------------------------------- 6 suffixes

def brute_suffixes(texts, window):
    first, out = {}, []
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for p in range(len(b) - window + 1):
            first.setdefault(b[p : p + window], d)
    for d, b in enumerate(data):
        dead = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if first[b[p : p + window]] < d:
                dead[p : p + window] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~dead])
        out.append((len(b), int(dead.sum()), int((np.diff(np.r_[0, dead.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("segment", [1 << 20, 300])
def test_suffix_dedup_against_brute_force(spark, segment):
    rng = random.Random(6)
    passage = prose(rng, 40)
    texts = []
    for i in range(60):
        t = prose(rng, rng.randint(0, 60), 12 if i % 2 else 4000)
        if i % 3 == 0:
            t = t[: len(t) // 2] + passage[rng.randint(0, 30) :] + t[len(t) // 2 :]
        texts.append(t)
    texts += [texts[3], texts[3][7:] + "é" * 80, None, "", "a" * 400, "a" * 300, "short", "é" * 90, passage * 6]
    old = radix_dedup.SEGMENT
    try:
        radix_dedup.SEGMENT = segment
        rows = radix_dedup.removed(clashing(spark, texts)).collect()
    finally:
        radix_dedup.SEGMENT = old
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute_suffixes(texts, 50)


def test_suffix_dedup_odd_ids(spark):
    t = prose(random.Random(1), 60, 4000)
    df = docs_of(spark, [t, t, t, t], [2, 2, None, 9])
    assert sorted((r["doc_id"] or -1, r["n_removed"] > 0) for r in radix_dedup.removed(df).collect()) == [(-1, False), (2, False), (2, False), (9, True)]
    assert radix_dedup.removed(df.where("false")).count() == 0


def test_sliding_argmin():
    v = np.random.default_rng(0).integers(0, 9, 200).astype(np.uint64)
    assert radix_dedup.sliding_argmin(v, 27).tolist() == [i + int(v[i : i + 27].argmin()) for i in range(174)]


# ---------------------------------------------------------------- 7 languages

def test_language_held_out(spark):
    d = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op7_language_kernel(spark, d).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got) and len(got) == 1000
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97


def test_language_odd_rows(spark):
    docs = docs_of(spark, [None, "", "123 !?", "hello there", "hello there"])
    got = [r["lang_pred"] for r in language_kernel.identify(docs).orderBy("doc_id").collect()]
    assert got == ["und"] * 3 + ["en"] * 2
    nothing = docs.withColumn("lang", docs["lang"].substr(9, 1)).replace("", None, "lang")
    assert {r["lang_pred"] for r in language_kernel.identify(nothing).collect()} == {"und"}
    assert language_kernel.identify(docs.where("false")).count() == 0


def test_language_kernel_against_dense_formulas():
    """Overlaps, Nystroem columns and ridge solution against presence vectors written out."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abc " if i % 2 else "cde ") for _ in range(rng.randint(5, 60))) for i in range(40)]
    langs = ["x" if i % 2 else "y" for i in range(40)]
    codes = [language_kernel.grams(t) for t in texts]
    have = np.unique(np.concatenate(codes))
    dense = np.stack([np.isin(have, c) for c in codes]).astype(float)
    unit = dense / np.linalg.norm(dense, axis=1, keepdims=True)
    picked = language_kernel.pick(langs)[:12]
    inverted = language_kernel.invert([codes[i] for i in picked])
    overlap = np.stack([language_kernel.shared(c, inverted, len(picked)) for c in codes])
    assert (overlap == dense @ dense[picked].T).all()
    k_xl = unit @ unit[picked].T
    names, weights = language_kernel.fit(k_xl, picked, langs)
    w = np.diag(1 / np.array([langs.count(a) for a in langs]))
    target = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    want = np.linalg.solve(k_xl.T @ w @ k_xl + language_kernel.RIDGE * unit[picked] @ unit[picked].T + 1e-6 * np.eye(len(picked)), k_xl.T @ w @ target)
    assert names == ["x", "y"] and np.allclose(weights, want)
    words = "the cat sat"
    assert len(language_kernel.grams(words)) == len({words[i : i + n] for n in (1, 2, 3, 4) for i in range(len(words) - n + 1)})


def test_language_with_clashing_names(spark):
    docs = clashing(spark, ["hello there friend", "guten tag mein freund", None]).selectExpr("*", "CASE doc_id WHEN 1 THEN 'de' ELSE 'en' END AS lang", "1 AS score", "'z' AS lang_pred", "'q' AS k")
    got = language_kernel.identify(docs.unionByName(docs)).collect()
    assert len(got) == 6 and {r["lang_pred"] for r in got if r["doc_id"] == 2} == {"und"}


def test_language_of_megabyte_texts(spark):
    rng = random.Random(7)
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    words = {}
    for r in train.orderBy("doc_id").collect():
        words.setdefault(r["lang"], []).extend((r["text"] or "").split())
    long, want = [], {}
    for lang, ws in sorted(words.items()):
        for share in (0.0, 0.05):  # names and rare words bring nearly every letter pair and triple of other languages
            out, size = [], 0
            while size < 1_000_000:
                out.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 10))) if rng.random() < share else rng.choice(ws))
                size += len(out[-1]) + 1
            long.append((len(long), " ".join(out)))
            want[len(want)] = lang
    got = {r["doc_id"]: r["lang_pred"] for r in language_kernel.predict(spark.createDataFrame(long, "doc_id long, text string"), train).collect()}
    assert len(words) > 2 and got == want


# ---------------------------------------------------------------- 8 join

def brute_join(texts, size, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    comp = list(range(len(texts)))
    find = lambda x: x if comp[x] == x else find(comp[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size, percent, hot, block", [(4, 85, 24, 256), (5, 80, 2, 3), (1, 50, 3, 2), (3, 100, 24, 256)])
def test_join_against_brute_force(spark, monkeypatch, size, percent, hot, block):
    rng = random.Random(size)
    texts = []
    for i in range(12):
        base = prose(rng, rng.choice([3, 6, 12, 40, 90]), 500).split()
        for k in range(rng.randint(1, 12)):
            t = list(base)
            for _ in range(rng.randint(0, 1 + len(t) // 30)):
                t[rng.randrange(len(t))] = f"v{rng.randint(0, 9999)}"
            texts.append(" ".join(t))
    line = prose(rng, 30, 9999)
    texts += [line + " " + prose(rng, 12, 9999) for _ in range(30)] + [None, "", "  ", "A b", "a\tB", "x " * 3000, "one"]
    monkeypatch.setattr(group_join, "BLOCK", block)
    found = group_join.hot_tokens(clashing(spark, texts), size, hot)
    monkeypatch.setattr(group_join, "hot_tokens", lambda *a: found)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.join(clashing(spark, texts), size, percent).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts, size, percent)


def test_join_of_megabyte_texts_and_clashing_names(spark):
    text = " ".join(f"w{i % 90_001}" for i in range(250_000))
    docs = clashing(spark, [text, text + " end", "short text of six words here", None]).selectExpr("*", "1 AS grp", "2 AS a", "'x' AS side", "7 AS component_id")
    assert {r["doc_id"]: r["component_id"] for r in group_join.join(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    out = group_join.drop_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


def test_join_moves_all_texts_beyond_the_lookup(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 80, 9999)
    texts = [base + f" tail{i}" for i in range(6)] + [prose(rng, 40, 9999) for _ in range(6)]
    want = brute_join(texts, 4, 85)
    for limit in (0, 500_000):
        monkeypatch.setattr(group_join, "LOOKUP", limit)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.join(docs_of(spark, texts)).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_join_of_a_large_family_is_not_quadratic(spark, monkeypatch):
    """Near copies of one text, in blocks of four: what is sent grows with the family, not with its square."""
    rng = random.Random(4)
    base = prose(rng, 200, 99999).split()
    texts = []
    for i in range(240):
        t = list(base)
        t[rng.randrange(len(t))] = f"v{i}"
        texts.append(" ".join(t))
    texts += [prose(rng, 30, 9999) for _ in range(20)]
    monkeypatch.setattr(group_join, "BLOCK", 4)
    sent, plain = [], group_join.opened
    monkeypatch.setattr(group_join, "opened", lambda docs, members, *a: (sent.append(members.count()), plain(docs, members, *a))[1])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in group_join.join(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_join(texts, 4, 85)
    assert sum(sent) < 15 * len(texts)


def test_join_odd_rows(spark):
    df = docs_of(spark, ["a b c d e", "a b c d e", "a b c d e", None], [4, 4, None, 5])
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in group_join.join(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("5", "5"), ("None", "None")]
    assert group_join.join(df.where("false")).count() == 0
    assert group_join.drop_duplicates(df).columns == df.columns


# ---------------------------------------------------------------- 9 packing

def test_fullest_is_best():
    rng = random.Random(9)
    for _ in range(50):
        sizes = sorted({rng.randint(1, 40): rng.randint(1, 3) for _ in range(5)}.items(), reverse=True)
        room = rng.randint(1, 90)
        sums = {0}
        for s, n in sizes:
            sums = {x + k * s for x in sums for k in range(n + 1) if x + k * s <= room}
        used = bin_slack.fullest(sizes, room)
        assert sum(s * n for s, n in used) == max(sums) and all(n <= dict(sizes)[s] for s, n in used)


def check_packing(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    d = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op9_bin_slack(spark, d).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for doc in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = [*tokenizer.encode(doc["text"], add_special_tokens=False).ids, 0]
        pieces = sorted(by[doc["doc_id"]], key=lambda r: r["piece"])
        assert [(r["start"], r["length"]) for r in pieces] == [(i, min(2048, len(ids) - i)) for i in range(0, len(ids), 2048)]
        for r in pieces:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    n = check_packing(rows)
    assert n <= math.ceil(sum(r["length"] for r in rows) / 2048) + 2


def test_encoder_is_exact():
    encoder = bin_slack.encoder_of(queries.tokenizer_path())
    texts = ["İstanbul ΣΑΣ don't I'M x.y a., A.B. naïve b <|endoftext|> a<|endoftext|>.", "", None, "a\x1cb \x1f\x0b q", "Ǆ ß. ŉ, ﬁ 12,5 é́ é ́a", "..,,a.　b  c", "word### tail&&& it's,' x_y", "日本語 テスト。 " * 3]
    want = [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() if t else b"" for t in texts]
    assert list(encoder.encode(texts)) == want


def test_encoder_falls_back_to_whole_texts():
    import public_tokenizers

    assert not bin_slack.encoder_of(queries.tokenizer_path()).whole
    encoder = bin_slack.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["Two  words and\nlines ", "", None, "İ ß don't"]
    assert encoder.whole and list(encoder.encode(texts)) == [np.array(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_encoder_forgets_by_bytes(monkeypatch):
    monkeypatch.setattr(bin_slack, "CACHE", 20_000)
    encoder, rng = bin_slack.Encoder(queries.tokenizer_path()), random.Random(2)
    for _ in range(20):
        texts = [prose(rng, 40, 9999) + " é.x" for _ in range(5)]
        assert list(encoder.encode(texts)) == [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert encoder.held < 300_000


def test_packing_in_parts(spark, monkeypatch):
    monkeypatch.setattr(bin_slack, "PART", 5)
    df = clashing(spark, ["a b c"] * 40 + ["d " * k for k in range(60)] + ["long word " * 700_000])
    rows = bin_slack.pack(df, queries.tokenizer_path(), 64).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and {r["doc_id"] for r in rows} == set(range(101))
    assert check_packing(rows, 64) <= math.ceil(sum(r["length"] for r in rows) / 64) + 1


def test_packing_odd_rows(spark):
    df = docs_of(spark, [None, "", "word", "word", "long word " * 3000], [1, 2, 3, 3, None])
    rows = bin_slack.pack(df, queries.tokenizer_path()).collect()
    check_packing(rows)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2)) == [1, 1] and sum(r["doc_id"] == 3 for r in rows) == 2
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == 6001
    assert bin_slack.pack(df.where("false"), queries.tokenizer_path()).count() == 0


# ---------------------------------------------------------------- 10 decontamination

@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_decontamination_against_brute_force(spark, limit):
    rng = random.Random(10)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 10, 14, 30]), 6)) for i in range(20)] + [(20, None), (21, "Solo"), (None, "null id words")]
    texts = [prose(rng, rng.randint(0, 80), 6) for _ in range(60)] + [None, "", "!!!", "SOLO solo", "x " * 5000]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: r for r in decontaminate.scan(clashing(spark, texts), bench, limit=limit).collect()}
    windows = {}
    for i, t in items:
        w = decontaminate.words_of(t)
        m = min(10, len(w))
        for k in range(len(w) - m + 1):
            if m and i is not None:
                windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    for d, t in enumerate(texts):
        w = decontaminate.words_of(t)
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                who = windows.get(tuple(w[k : k + m]))
                if who:
                    hit |= set(range(k, k + m))
                    found |= who
        r = got[d]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(w), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(clashing(spark, texts), bench, limit=limit).collect()}
    assert kept == {d for d in got if not got[d]["contaminated"]}


def test_automaton_is_packed():
    """A benchmark at the limit of one part takes tens of MB, not a GB: measured at a twentieth of it."""
    import tracemalloc

    rng = random.Random(1)
    items = [(i, " ".join(f"w{rng.randrange(30_000)}" for _ in range(100))) for i in range(decontaminate.PASS_WORDS // 2_000)]
    tracemalloc.start()
    machine = decontaminate.Automaton(items)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size * 20 < 400e6, size
    words = decontaminate.words_of(f"a b {items[7][1]} c {items[9][1]}")
    hit, found = machine.find(words)
    assert found == {7, 9} and sum(hit) == 200
    assert decontaminate.automaton("x", items[:3], 10) is decontaminate.automaton("x", [], 10) is not decontaminate.automaton("y", items[:3], 10)


def test_decontamination_of_megabyte_texts_in_parts(spark):
    """A benchmark of some megabytes in several parts against one automaton, on long texts."""
    rng = random.Random(12)
    items = [(i, prose(rng, 60, 99_999)) for i in range(6_000)]
    texts = [" ".join(w for i in range(k, 6_000, 37) for w in (items[i][1], prose(rng, 9, 99_999))) for k in range(3)] + [prose(rng, 200_000, 99_999), None]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of(spark, texts)
    one = sorted(decontaminate.scan(docs, bench).collect())
    assert one == sorted(decontaminate.scan(docs, bench, limit=100_000).collect()) and [r["n_items"] for r in one[:3]] == [163, 163, 163]
    assert decontaminate.scan(docs, bench.where("false")).where("n_hit > 0").count() == 0 == decontaminate.scan(docs.where("false"), bench).count()


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_decontamination_by_items_without_id(spark, tmp_path, limit):
    import duckdb

    items = [(1, "alpha beta gamma"), (None, "delta epsilon"), (None, "zeta eta theta"), (2, "delta epsilon"), (None, None)]
    texts = ["x zeta eta theta y", "alpha beta gamma zeta eta theta", "a delta epsilon", "zeta eta theta delta epsilon", "nothing here", None]
    docs, bench = docs_of(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path / name}/*.parquet'")
    rel = con.sql(queries.ORACLES["op10_decontaminate"])
    want = sorted(tuple(dict(zip(rel.columns, r))[c] for c in sorted(rel.columns)) for r in rel.fetchall())
    got = decontaminate.scan(docs, bench, limit=limit).collect()
    assert sorted(tuple(r[c] for c in sorted(rel.columns)) for r in got) == want
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in got} == {0: (3, 1), 1: (6, 2), 2: (2, 2), 3: (5, 2), 4: (0, 0), 5: (0, 0)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench, limit=limit).collect()} == {4, 5}


# ---------------------------------------------------------------- pipeline and SQL

def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.cut(stage(spark, docs, d))
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert len({c for _, c in brute_join(texts, 5, 80)}) == n
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, d).collect()
    assert len({r["doc_id"] for r in rows}) == n
    check_packing(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    want = sorted((tuple(map(str, (dict(zip(rel.columns, r))[c] for c in sorted(rel.columns)))) for r in rel.fetchall()))
    got = sorted(tuple(str(r[c]) for c in sorted(rel.columns)) for r in queries.QUERIES[name](spark, d).collect())
    assert got == want
