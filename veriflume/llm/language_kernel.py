"""Language identification with blended-spectrum presence kernels.

k(x, y) = <p(x), p(y)> / (|p(x)| |p(y)|), p(x) being the presence vector of all character n-grams of 1 to 4 characters
of the whole lower-cased text. n-grams keep a coordinate each (sparse sets of 64-bit codes), so no length of text fills the
space. A Nyström sample of landmark documents spans the model; one-versus-rest kernel ridge regression is solved over it in
closed form. Landmarks and weights multiply to one row of weights for each n-gram that a landmark has, and a text's scores
are the sum of its n-grams' rows over its length |p(x)|.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_small, mix

LANDMARKS, RIDGE = 192, 0.3
#: training texts kept for the fit, a language, and in all; chosen by the hash of doc_id
PER_LANGUAGE, TRAINING = 1500, 12_000
#: characters of a text turned into codes at once
SEGMENT = 1 << 20
_TOP, _ODD = np.uint64(1 << 63), np.uint64(0x9E3779B97F4A7C15)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def grams(text: str) -> np.ndarray:
    """Sorted codes of the distinct n-grams; runs of characters that are not letters count as one space.

    Codes of up to three characters are the characters themselves (21 bits each), those of four are 63-bit hashes.
    """
    low = text.lower()
    parts, tail, after = [], np.zeros(0, np.uint64), False
    for at in range(0, len(low), SEGMENT):
        chars = np.frombuffer(low[at : at + SEGMENT].encode("utf-32-le", "surrogatepass"), np.uint32)
        if chars.max() < 128:
            letter = (chars - 97) < 26
        else:
            letter = (((chars - np.uint32(97)) < 26) | (chars > 0xA0)) & ~np.isin(chars, (0xAB, 0xBB, 0x2018, 0x2019, 0x201C, 0x201D, 0x2013, 0x2014, 0x3000))
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # one separator after a word
        keep[0] |= after
        after = letter[-1]
        chars = np.concatenate([tail, np.where(letter, chars, np.uint32(32))[keep].astype(np.uint64)])
        tail = chars[-3:]
        two = (chars[:-1] << np.uint64(21)) | chars[1:]
        three = (two[:-1] << np.uint64(21)) | chars[2:]
        four = (mix(three[:-1]) + chars[3:] * _ODD) | _TOP
        three = _distinct(three)
        two = _distinct(np.concatenate([three >> np.uint64(21), two[-1:]]))
        one = _distinct(np.concatenate([two >> np.uint64(21), chars[-1:]]))
        parts.append(np.concatenate([one, two, three, _distinct(four)]))
    if len(parts) == 1:
        return parts[0]
    return _distinct(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def places(codes: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Where the codes stand in the sorted codes `have`, for those that do."""
    if not len(have):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(have, codes), len(have) - 1)
    return at[have[at] == codes]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def invert(marks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, first, who) of the landmarks' sets: codes[i] is in the landmarks who[first[i] : first[i + 1]]."""
    every, who = np.concatenate(marks), np.repeat(np.arange(len(marks), dtype=np.int16), [len(m) for m in marks])
    order = np.argsort(every, kind="stable")
    every, who = every[order], who[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    return every[new], np.append(np.flatnonzero(new), len(every)), who


def shared(codes: np.ndarray, inverted: tuple[np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """How many of the codes each of the n landmarks has."""
    have, first, who = inverted
    at = places(codes, have)
    size = first[at + 1] - first[at]
    flat = np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
    return np.bincount(who[flat], minlength=n)


def pick(langs: list[str]) -> list[int]:
    """Places of the landmarks, in turn from every language."""
    order = {n: [i for i, x in enumerate(langs) if x == n] for n in sorted(set(langs))}
    picked: list[int] = []
    depth = 0
    while len(picked) < min(LANDMARKS, len(langs)):
        picked += [v[depth] for v in order.values() if depth < len(v)][: LANDMARKS - len(picked)]
        depth += 1
    return picked


def fit(k_xl: np.ndarray, picked: list[int], langs: list[str]) -> tuple[list[str], np.ndarray]:
    """(languages, weights [landmarks, languages]). k_xl: kernel values of all texts with the landmarks."""
    names = sorted(set(langs))
    target = np.array([[1.0 if a == b else -1.0 for b in names] for a in langs])
    weight = 1 / np.sqrt(np.array([langs.count(a) for a in langs]))[:, None]  # languages of few texts count too
    a = (k_xl * weight).T @ (k_xl * weight) + RIDGE * k_xl[picked] + 1e-6 * np.eye(len(picked))
    return names, np.linalg.solve(a, (k_xl * weight).T @ (target * weight))


def predict(docs: DataFrame, train: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score) of every row of docs. train: (doc_id, text, lang).

    Null texts and texts without a letter are 'und' with score 0; so is everything when nothing can be learned from.
    Ties go to the first language by name. Repeated rows each give a row. The fit takes at most about PER_LANGUAGE texts of
    each language and TRAINING in all (the rows with the lowest hashes); scoring reads every text whole.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), "lang")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = min(PER_LANGUAGE, max(1, TRAINING // max(1, len(counts))))
    model = spark.sparkContext.broadcast(_learn(_sample(usable, counts, share)) if counts else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model.value and has_letter(t)]
            for i in known:
                names, have, weights = model.value
                codes = grams(texts[i])
                raw = weights[places(codes, have)].sum(0, dtype=np.float64) / np.sqrt(max(1, len(codes)))
                e = np.exp(2 * (raw - raw.max()))
                best = int(raw.argmax())
                lang[i], score[i] = names[best], e[best] / e.sum()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": score})

    return map_small(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, lang_pred string, score double")


def _sample(usable: DataFrame, counts: dict[str, int], share: int) -> DataFrame:
    """About `share` rows of each language, by the hash of doc_id."""
    rate = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, share / n)))])
    return usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(rate, F.col("lang")) * (1 << 20)).select("doc_id", "text", "lang")


def _learn(sample: DataFrame):
    """(languages, codes, weights [codes, languages]) fitted on whole sampled texts, whose n-grams are taken on the executors; None without any.

    Only the landmarks' sets of n-grams come to the driver, and for each other text its overlap with every landmark.
    """
    spark, kind = sample.sparkSession, sample.schema["doc_id"].dataType.simpleString()
    sample = cut(sample.where("doc_id IS NOT NULL").withColumn("t", F.xxhash64("text")))

    def lettered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.loc[[has_letter(t) for t in pdf["text"]], ["doc_id", "lang", "t"]]

    keys = sorted(tuple(r) for r in map_small(sample, lettered, f"doc_id {kind}, lang string, t long").collect())
    if not keys:
        return None
    picked = pick([x for _, x, _ in keys])
    wanted = {keys[i] for i in picked}

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            some = pdf[[k in wanted for k in zip(pdf["doc_id"], pdf["lang"], pdf["t"])]]
            yield pd.DataFrame({"doc_id": some["doc_id"], "lang": some["lang"], "t": some["t"], "codes": [grams(t).tobytes() for t in some["text"]]})

    near = sample.where(F.col("t").isin(sorted({t for *_, t in wanted})))
    found = {tuple(r)[:3]: np.frombuffer(bytes(r["codes"]), np.uint64) for r in map_small(near, sets, f"doc_id {kind}, lang string, t long, codes binary").collect()}
    marks = [found[keys[i]] for i in picked]
    inverted = spark.sparkContext.broadcast(invert(marks))
    length = np.sqrt([max(1, len(m)) for m in marks])

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[[has_letter(t) for t in pdf["text"]]]
            k = []
            for t in pdf["text"]:
                codes = grams(t)
                k.append((shared(codes, inverted.value, len(length)) / (length * np.sqrt(max(1, len(codes))))).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "t": pdf["t"], "k": k})

    got = {tuple(r)[:3]: bytes(r["k"]) for r in map_small(sample, rows, f"doc_id {kind}, lang string, t long, k binary").collect()}
    k_xl = np.frombuffer(b"".join(got[k] for k in keys)).reshape(len(keys), -1)
    names, weights = fit(k_xl, picked, [x for _, x, _ in keys])
    have, first, who = inverted.value
    each = np.zeros((len(have), len(names)), np.float32)
    np.add.at(each, np.repeat(np.arange(len(have)), np.diff(first)), (weights / length[:, None]).astype(np.float32)[who])
    return names, have, each


def identify(docs: DataFrame, fold: int = 0, folds: int = 5) -> DataFrame:
    """predict() learned from documents outside the held-out fold: crc32(doc_id as text) mod folds = fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    out = predict(docs, docs.where(~held))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
