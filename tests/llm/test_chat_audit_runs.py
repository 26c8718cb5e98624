"""Chat formatting, filter audit and periodic runs against loops; null, empty, long, tied, repeated and clashing input."""

import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest

from veriflume.llm import chat_format, filter_audit, periodic_runs, queries

CHAT = "conv_id long, turn long, role string, text string"


# ---------------------------------------------------------------- 11 chat format

def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["piece"]
    return out


def texts_under_loss(rows):
    return [r["piece"][r["text_start"] : r["text_stop"]] for r in sorted(rows, key=lambda r: r["place"]) if r["loss"]]


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|im_end|>\\", "<<\\\\|a|<|", "|<", "<", "\\<\\\\\\|\n<|im_start|>user\n", "a" * 10])
def test_markup_is_reversible(text):
    m = chat_format.Markup()
    assert m.unescape(m.escape(text)) == text and "<|" not in m.escape(text)
    turns = [{"role": "us|er\n\\n", "text": text}, {"role": "assistant", "text": text}]
    assert m.read(m(turns)) == ([(t["role"], t["text"]) for t in turns], "")


def brute_chat(rows):
    m, by = chat_format.Markup(), {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns = [t[2:] for t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), digest(loss), len(m([{"role": r, "text": t} for r, t in turns])))
    return out


@pytest.mark.parametrize("reach, block", [(32, 2048), (4, 7), (2, 3)])
def test_chat_against_loops(spark, reach, block):
    rng = random.Random(block)
    text = lambda: "".join(rng.choice(["a", "b ", "<", "|", "\\", "<|im_end|>", "<|im_start|>assistant\n", "é", "\n"]) for _ in range(rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), text()) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(77, t, rng.choice(["user", "assistant"]), text()) for t in range(150)]  # one conversation with most of the rows
    rows += [(None, 0, "user", "x"), (None, None, "assistant", None), (5, None, None, None), (6, 0, "assistant", "tie"), (6, 0, "assistant", "tie"), (8, 3, "assistant", "z" * 400_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, CHAT).selectExpr("*", "1 AS place", "2 AS block", "3 AS far_id", "4 AS piece")
    turns = chat_format.format_turns(df, reach=reach, block=block)
    got = {r[0]: tuple(r[1:]) for r in chat_format.digest(turns).collect()}
    assert got == brute_chat(rows)
    assert chat_format.format_turns(df.where("false")).count() == 0


def test_chat_templates_that_remember_or_rewrite(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t}") for c, n in ((1, 5), (2, 30)) for t in range(n)]
    df = spark.createDataFrame(rows, CHAT)

    def numbered(messages):  # every turn depends on how many came before
        return "^" + "".join(f"[{i}|{m['role']}]{m['text']};" for i, m in enumerate(messages))

    got = chat_format.format_turns(df, numbered, reach=4, block=6).collect()
    assert joined(got) == {c: numbered([{"role": r, "text": t} for k, _, r, t in rows if k == c]) for c in (1, 2)}
    assert texts_under_loss(got) == [t for _, _, r, t in rows if r == "assistant"] and not any(r["rewrites"] for r in got)

    def forgetful(messages):  # thoughts before the last turn are cut
        return "^" + "".join(f"<{m['role']}>{m['text'] if m is messages[-1] else m['text'].split('-')[0]}</>" for m in messages)

    got = chat_format.format_turns(df, forgetful, reach=4, block=6).collect()
    assert joined(got) == {c: forgetful([{"role": r, "text": t} for k, _, r, t in rows if k == c]) for c in (1, 2)}
    last = {(1, 4), (2, 29)}
    assert all(r["rewrites"] == (r["turn"] > 0) and (r["text_start"] is None) == ((r["conv_id"], r["turn"]) not in last) for r in got)
    assert texts_under_loss(got) == ["2-29"]

    trims = lambda messages: "".join(f"{m['role']}:{m['text'].strip()}\n" for m in messages if m["role"] != "user")
    df = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "  a "), (1, 2, "tool", "b")], CHAT)
    got = sorted(chat_format.format_turns(df, trims).collect(), key=lambda r: r["place"])
    assert [r["piece"] for r in got] == ["", "assistant:a\n", "tool:b\n"] and texts_under_loss(got) == ["a"] and got[0]["text_start"] is None


# ---------------------------------------------------------------- 12 filter audit

def brute_audit(docs, labels, part=lambda d: d["lang"]):
    fails, parts = [], []
    for d in docs:
        text = d["text"] or ""
        words = text.translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ")
        words = [w for w in words if w]
        copy = d["doc_id"] is not None and any((e["text"] or "") == text and e["doc_id"] is not None and e["doc_id"] < d["doc_id"] for e in docs)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text), "E": copy}
        mine = [x for x in labels if x["doc_id"] == d["doc_id"] and d["doc_id"] is not None]
        fails.append((f, any(x["quality"] == 1 for x in mine), any(x["toxic"] == 1 for x in mine)))
        parts.append(part(d) or "")
    out = {}
    for p in set(parts):
        rows = [f for f, q in zip(fails, parts) if q == p]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order):
                gone = [r for r in left if r[0][x]]
                left = [r for r in left if not r[0][x]]
                failing = sum(r[0][x] for r in rows)
                alone = sum(r[0][x] and sum(r[0].values()) == 1 for r in rows)
                out[p, "".join(order), step + 1] = [len(left), len(gone), failing - len(gone), alone, sum(r[1] for r in gone), sum(r[2] for r in gone)]
                shapley[x] += len(gone)
        for (q, order, step), v in out.items():
            if q == p:
                v.append(shapley[order[step - 1]])
    return out


@pytest.mark.parametrize("chains", [filter_audit.CHAINS, 300])
def test_audit_against_loops(spark, chains, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(filter_audit, "CHAINS", chains)
    monkeypatch.setattr(filter_audit.masks, "__defaults__", ("lang", None, chains))
    pool = [" ".join(rng.choice(["ab", "C", "d", "E#", "é", "fg"]) for _ in range(n)) for n in (0, 1, 3, 250, 260, 300)]
    pool += [" ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " $", None, "", " \t\r\n", "word " * 60_000]
    docs = [{"doc_id": rng.choice([None, *range(60)]), "text": rng.choice(pool), "lang": rng.choice(["en", "de", None, ""])} for _ in range(150)]
    docs += [{"doc_id": 3, "text": pool[4], "lang": "en"}] * 3
    labels = [{"doc_id": rng.choice([None, *range(60)]), "quality": rng.choice([0, 1, None]), "toxic": rng.choice([0, 1, None])} for _ in range(50)]
    df = spark.createDataFrame([(d["doc_id"], d["text"], d["lang"], 1, 2) for d in docs], "doc_id long, text string, lang string, part int, mask int").repartition(3)
    marks = spark.createDataFrame([tuple(x.values()) for x in labels], "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in filter_audit.audit(df, marks).collect()}
    assert got == brute_audit(docs, labels)
    want = {d["doc_id"] for d in docs if d["doc_id"] is not None and any((e["text"] or "") == (d["text"] or "") and e["doc_id"] is not None and e["doc_id"] < d["doc_id"] for e in docs)}
    assert {r["doc_id"] for r in filter_audit.copies(df).collect()} == want
    assert filter_audit.audit(df.where("false"), marks).count() == 0 and filter_audit.audit(df, marks.where("false")).count() == len(got)


def test_chains_tell_texts_of_one_fingerprint_apart():
    held = filter_audit.Chains()
    lost = [x for args in ((1, b"a", 5, {"k": 1}), (1, b"b", 3, {"k": 1}), (1, b"a", 4, {"k": 1, "l": 2}), (1, b"a", 9, {"m": 1}), (1, b"b", 3, {"k": 1})) for x in held.add(*args)]
    assert lost == [(5, "k", 1), (9, "m", 1)]
    assert sorted(held.drain()) == [(1, b"a", 4, {"k": 1, "l": 2}), (1, b"b", 3, {"k": 2})] and held.size == 0


# ---------------------------------------------------------------- 13 periodic runs

def brute_runs(s):
    n, out = len(s), set()
    for q in range(1, n):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and s[j] == s[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(all(s[i + x] == s[i + x + d] for x in range(size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i) + 1
    return sorted(out)


def test_runs_against_loops():
    rng = random.Random(2)
    for _ in range(1500):
        s = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            unit = [rng.randrange(6) for _ in range(rng.randint(1, 9))]
            at = rng.randint(0, len(s))
            s[at:at] = [unit[i % len(unit)] for i in range(rng.randint(0, 50))]
        assert periodic_runs.find_runs(np.array(s, np.int64)) == brute_runs(s), s


def test_runs_where_plain_hashes_collide():
    """Thue-Morse words, whose halves polynomial hashes modulo 2**64 cannot tell apart."""
    morse = lambda n, x=0: [(i.bit_count() + x) % 2 for i in range(n)]
    s = morse(2048) + morse(2048, 1) + [5] * 9 + morse(300) * 5
    assert periodic_runs.find_runs(np.array(s)) == brute_runs(s)
    for s, want in (([1] * 300_000, [(0, 300_000, 1)]), ([1, 2] * 150_000 + [3] * 90_000, [(0, 300_000, 2), (300_000, 90_000, 1)]), (list(range(700)) * 500, [(0, 350_000, 700)])):
        assert periodic_runs.find_runs(np.array(s)) == want


def test_surviving_words_hold_all_runs():
    s = np.array([*range(50), 7, 8, 7, 8, 7, 8, 7, 8, *range(100, 150)])
    assert periodic_runs.surviving(s).tolist() == [[50, 58]] and periodic_runs.surviving(np.arange(90)).tolist() == []


def brute_runs_row(doc, text):
    words = [w for w in (text or "").translate(dict.fromkeys(map(ord, "\t\n\x0b\x0c\r"), " ")).split(" ") if w]
    n = len(words)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    keep = set(range(n)) - {i for a, m, q in runs for i in range(a + q, a + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(words[i] for i in sorted(keep))))


def test_runs_query_against_loops(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t\n", "a " * 5, "a " * 6, "a b\x85c d \x1f e", "no no no\tno\nno no yes " * 3, *(" ".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(0, 70))) for _ in range(150))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x " * 9), (3, "a " * 5), (3, "a " * 5)]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS runs", "2 AS n", "3 AS h", "4 AS words").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda r: tuple(map(str, r))
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=key)
    assert got == sorted((brute_runs_row(*r) for r in rows), key=key)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 5
    assert periodic_runs.detect(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_query_on_given_documents(spark):
    d = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = {r["doc_id"]: tuple(r) for r in queries.op13_periodic_runs(spark, d).collect()}
    short = [r for r in docs if len(r[1] or "") < 3000]
    assert len(got) == len(docs) and len(short) > 100
    assert all(got[r[0]] == brute_runs_row(*r) for r in short)


def test_runs_of_a_megabyte_text(spark):
    long = "one two three " * 100_000
    got = periodic_runs.detect(spark.createDataFrame([(1, long + "end " + "x " * 9)], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == [(0, 300_000, 3), (300_001, 9, 1)] and got["text"] == "one two three end x"
