"""Toxicity scoring by weak supervision.

1. Voters. Lexicon voters are general insults (SEEDS, which owe nothing to the labels) and words and word beginnings that the
   labelled training rows associate with toxic text; each votes toxic where it occurs and abstains elsewhere. Pattern voters
   look at how many lexicon voters fired, how dense they are and whether none did, and at shouting, runs of exclamation marks
   and masked words, whatever the words. The gold label is one more voter, of unknown accuracy.
2. Label model. A generative model of the votes on labelled and unlabelled documents alike, fitted by expectation-maximisation,
   estimates every voter's firing rates given the hidden class (its accuracy) and, from residual covariances given the class, the
   correlations between voters; voters that say the same thing share one vote. The gold voter abstains on unlabelled rows. It starts from
   the gold votes, and from the seeds' votes where there is none.
3. Classifier. Logistic regression on the voters' counts and the patterns is trained on the posterior labels. It alone
   scores texts, whole.

With use_gold=False, or without labels of both classes, neither the voters nor their model see a label: seeds and patterns alone make the
posterior labels, of unlabelled documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, map_small, turn_to

#: labelled and unlabelled rows of the fit (chosen by the hash of doc_id), lexicon voters, fewest toxic rows behind one
TRAINING, UNLABELLED, VOTERS, SUPPORT = 12_000, 6_000, 400, 4
#: shortest and longest word beginning used as a voter
STEMS = range(3, 9)
ROUNDS, L2 = 25, 1e-3
PREDICT_AT = 0.3
WORD = re.compile(r"[^\W\d_]+")
PATTERNS = 8
#: the patterns that vote: several hits, no hit, shouting, exclamations, masked words
VOTING = [2, 3, 5, 6, 7]
#: general insults and threats in English, German, French and Spanish; '*' stands for any ending
SEEDS = """
asshole bastard bitch clown coward cretin* crap damn* degenerate disgusting disgrace dumb* fool* freak* garbage hate hateful hideous idiot*
imbecile* jerk* kill liar* loser* lowlife lunatic moron* nasty pathetic pig* repulsive rubbish scum shit* shut sicken* stupid* subhuman trash*
ugly useless vermin vile worthless wretch*
abschaum arschloch* dreck* dumm* ekelhaft* feigling* hass* idiotisch* miststück* müll schwachkopf* schwein* trottel* verlierer* versager* widerlich* wertlos*
abruti* connard* connasse* crétin* débile* dégoût* haine imbécile* minable* moche nul ordure* pourri* salaud* salope* stupide* tais
asco asqueros* basura cabrón* cerdo* cállate despreciable* estúpid* gilipollas inútil* idiota* imbécil* mierda odio patétic* perdedor* tont*
""".split()
MASKED = re.compile(r"[^\W\d_][*@#$]{2,}|[^\W\d_][*@#$][^\W\d_]")
UPPER, LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])
#: words whose voters a task remembers
REMEMBERED = 200_000


def tokens_of(word: str, stems=STEMS) -> list[str]:
    """The voters a word may set off: itself and its beginnings (marked by a trailing '*')."""
    return [word, *(word[:n] + "*" for n in stems if n <= len(word))]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


class Voters:
    """Counts of lexicon hits and pattern values of a text."""

    def __init__(self, lexicon: list[str]):
        self.at = {t: i for i, t in enumerate(lexicon)}
        self.size = len(lexicon)
        self.stems = sorted({len(t) - 1 for t in lexicon if t.endswith("*")} | {*STEMS})
        self.known: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> tuple[dict[int, int], np.ndarray]:
        words = words_of(text)
        hits: dict[int, int] = {}
        fired = 0
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for word, n in Counter(words).items():
            mine = self.known.get(word)
            if mine is None:
                mine = self.known[word] = tuple(self.at[t] for t in tokens_of(word, self.stems) if t in self.at)
            if mine:
                fired += n
                for i in mine:
                    hits[i] = hits.get(i, 0) + n
        total = max(1, len(words))
        data = text.encode("utf-8", "surrogatepass") if text else b""
        letters = len(data) - len(data.translate(None, LETTERS))
        loud = letters >= 20 and 2 * (len(data) - len(data.translate(None, UPPER))) > letters
        masked = bool(text) and not data.isalnum() and MASKED.search(text) is not None
        return hits, np.array([math.log1p(fired), min(1.0, 20 * fired / total), fired > 1, fired == 0, math.log1p(total) / 10, loud, b"!!" in data, masked], np.float32)

    def row(self, text: str | None) -> np.ndarray:
        hits, pattern = self.of(text)
        out = np.zeros(self.size + PATTERNS, np.float32)
        for i, n in hits.items():
            out[i] = math.log1p(n)
        out[self.size :] = pattern
        return out


def label_model(votes: np.ndarray, gold: np.ndarray | None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, firing rates [voters, 2], weights) of binary votes and the gold voter (if any), by EM.

    gold: 1, 0, or NaN where it abstains. Rows with and without a gold vote have priors of their own: they were chosen otherwise.
    start: rows that are taken for class 1 at first; where gold votes, its vote counts instead.
    Correlations: residual covariance of votes given the posterior, taken anew every few turns; a voter's weight is one over the number
    of voters that it moves together with, itself included.
    """
    n = len(votes)
    gold = np.full(n, np.nan) if gold is None else np.asarray(gold, float)
    told = ~np.isnan(gold)
    yes = np.where(told, gold > 0, False if start is None else start)
    q = np.where(yes, 0.9, 0.05)
    weight = np.ones(votes.shape[1])
    rate = np.zeros((votes.shape[1], 2))
    for turn in range(ROUNDS):
        prior = np.empty(n)
        for rows in (told, ~told):
            prior[rows] = (q[rows].sum() + 1) / (rows.sum() + 2)
        for c, r in ((0, 1 - q), (1, q)):
            rate[:, c] = (r @ votes + 0.5) / (r.sum() + 1)
        g, t = gold[told], q[told]
        gold_rate = [((1 - t) @ g + 0.5) / ((1 - t).sum() + 1), (t @ g + 0.5) / (t.sum() + 1)]
        if turn % 4 == 2:
            left = votes - (np.outer(q, rate[:, 1]) + np.outer(1 - q, rate[:, 0])).astype(np.float32)
            cov = left.T @ left / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            weight = 1 / np.maximum(1, np.maximum(cov / np.outer(sd, sd), 0).sum(1))
        fires = np.log(rate[:, 1] / rate[:, 0]) * weight
        silent = np.log((1 - rate[:, 1]) / (1 - rate[:, 0])) * weight
        score = np.log(prior / (1 - prior)) + votes @ (fires - silent).astype(np.float32) + silent.sum()
        score[told] += np.where(g > 0, math.log(gold_rate[1] / gold_rate[0]), math.log((1 - gold_rate[1]) / (1 - gold_rate[0])))
        q = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return q, rate, weight


def logistic(x: np.ndarray, target: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of L2-regularised logistic regression on soft targets, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    w, damp = np.zeros(a.shape[1]), np.full(a.shape[1], L2 * len(x))
    damp[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        s = np.maximum(p * (1 - p), 1e-5)
        step = np.linalg.solve((a * s[:, None]).T @ a + np.diag(damp), a.T @ (target - p) - damp * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def lexicon_of(train: DataFrame, n_pos: int, n_neg: int, voters: int = VOTERS, support: int = SUPPORT) -> list[str]:
    """The tokens most associated with toxic rows, by the log-likelihood ratio of their document rates. train: (text, toxic)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            keys = list(pos.keys() | neg.keys())
            return pd.DataFrame({"token": keys, "pos": [pos[k] for k in keys], "neg": [neg[k] for k in keys]})

        pos, neg = Counter(), Counter()
        for pdf in batches:
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                (pos if toxic else neg).update({t for w in set(words_of(text)) for t in tokens_of(w)})
            if len(pos) + len(neg) > 400_000:
                yield flush()
                pos, neg = Counter(), Counter()
        yield flush()

    rates = map_small(train, count, "token string, pos long, neg long").groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = n_pos / (n_pos + n_neg)
    term = lambda seen, part: F.when(seen > 0, seen * F.log(seen / ((F.col("pos") + F.col("neg")) * part))).otherwise(0.0)
    gain = term(F.col("pos"), share) + term(F.col("neg"), 1 - share)
    likely = F.col("pos") * n_neg > 2 * n_pos * F.col("neg")
    best = rates.where((F.col("pos") >= support) & likely).select("token", "pos", "neg", gain.alias("gain")).where("gain > 6").orderBy(F.desc("gain"), "token").limit(8 * voters).collect()
    # a beginning that says as much already speaks for the longer ones it covers
    kept: dict[str, float] = {}
    for r in best:
        stem = r["token"].rstrip("*")
        above = [kept[stem[:n] + "*"] for n in STEMS if n <= len(stem) and stem[:n] + "*" in kept]
        if not any(g >= r["gain"] for g in above):
            kept[r["token"]] = r["gain"]
        if len(kept) == voters:
            break
    return list(kept)


def fit(docs: DataFrame, gold: DataFrame, use_gold: bool = True):
    """A model (lexicon, weights, intercept) of documents (doc_id, text) and the labels of some of them (doc_id, toxic 0/1).

    The label model sees labelled and unlabelled rows; the classifier is trained on the posteriors of the labelled ones, or, where labels are not
    used or lack a class, on those of the unlabelled. None if nothing speaks for class 1: no seed fires, no row is labelled toxic.
    """
    n = {r["toxic"]: r["n"] for r in gold.groupBy("toxic").agg(F.count("*").alias("n")).collect()} if use_gold else {}
    use_gold = bool(n.get(0) and n.get(1))
    # all toxic rows up to half of the bound, and clean ones for the rest, and some without a label; so few ids are broadcast, and no text is moved
    share = {1: min(1.0, TRAINING / 2 / n[1]), 0: min(1.0, TRAINING / 2 / n[0])} if use_gold else {1: 0.0, 0: 0.0}
    part = lambda salt: F.pmod(F.xxhash64("doc_id", *salt), F.lit(1 << 20)) / (1 << 20)
    picked = gold.where(part([]) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]))
    free = min(1.0, UNLABELLED / max(1, docs.count()))
    chosen = docs.join(F.broadcast(picked), "doc_id", "left").where(F.col("toxic").isNotNull() | (part([F.lit(7)]) < free) & ~held_out())
    other = gold.select("doc_id", F.lit(True).alias("labelled"))
    sample = chosen.join(other, "doc_id", "left").where("toxic IS NOT NULL OR labelled IS NULL" if use_gold else "true").drop("labelled")
    sample = cut(sample if use_gold else sample.withColumn("toxic", F.lit(None).cast("int")))
    lexicon = list(SEEDS)
    if use_gold:
        mine = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if mine.get(0) and mine.get(1):
            found = lexicon_of(sample.where("toxic IS NOT NULL").select("text", "toxic"), mine[1], mine[0])
            lexicon = [*found, *(t for t in SEEDS if t not in set(found))]
        else:
            use_gold = False  # labels of both classes, documents of one
    seeds = np.isin(lexicon, SEEDS)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        voters = Voters(lexicon)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "row": [voters.row(t).astype(np.float16).tobytes() for t in pdf["text"]]})

    kind = sample.schema["doc_id"].dataType.simpleString()
    rows = [(r["doc_id"], r["toxic"] if use_gold else None, bytes(r["row"])) for r in map_small(sample, features, f"doc_id {kind}, toxic int, row binary").collect()]
    if not rows:
        return None
    rows.sort(key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))
    x = np.frombuffer(b"".join(r for *_, r in rows), np.float16).reshape(len(rows), -1).astype(np.float32)
    votes_of = np.array([np.nan if t is None else t for _, t, _ in rows], np.float64)
    size = len(lexicon)
    votes = np.hstack([x[:, :size] > 0, x[:, [size + k for k in VOTING]] > 0]).astype(np.float32)
    start = (votes[:, :size][:, seeds] > 0).any(1)
    if not use_gold and not start.any():
        return None
    posterior, _, _ = label_model(votes, votes_of, start)
    taught = ~np.isnan(votes_of) if use_gold else np.ones(len(rows), bool)
    w, b = logistic(x[taught], np.clip(posterior[taught], 0.01, 0.99))
    if use_gold:
        b += math.log(share[0] / share[1])  # back to the corpus's own share of toxic rows
    return lexicon, w.astype(np.float32), b


def score(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score, predicted) of every row; without a model everything scores 0."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        turn_to("toxicity")
        got = shared.value
        voters = Voters(got[0]) if got else None
        for pdf in batches:
            s = np.zeros(len(pdf))
            if got:
                s = np.fromiter((_one(voters, got, t) for t in pdf["text"]), float, len(pdf))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": s, "predicted": (s >= PREDICT_AT).astype(np.int32)})

    return map_small(docs.select("doc_id", F.col("text").cast("string").alias("text")), run, f"doc_id {kind}, score double, predicted int")


def _one(voters: Voters, model, text: str | None) -> float:
    hits, pattern = voters.of(text)
    _, w, b = model
    z = b + float(pattern @ w[voters.size :]) + sum(w[i] * math.log1p(n) for i, n in hits.items())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, use_gold: bool = True):
    """The model learned from documents, and the labels of those that are not held out.

    Null labels are ignored; several labels of a document count as toxic when at least half are. Texts are null-safe: a null
    text is a training row without words.
    """
    gold = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    gold = gold.where(~held_out())
    return fit(docs.select("doc_id", F.col("text").cast("string").alias("text")), gold, use_gold)


def judge(docs: DataFrame, labels: DataFrame, use_gold: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: null and empty texts too; repeated rows each give one.

    Equal texts get equal scores. Without labels of both classes on documents that are there, seeds and patterns alone decide; where no
    seed fires either, every score is 0.
    """
    return score(docs, train(docs, labels, use_gold)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, at: float = PREDICT_AT) -> DataFrame:
    """The rows of docs, all columns kept, that score under `at`; all of them where there is nothing to learn from."""
    model = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[str | None], bool]:
        turn_to("toxicity")
        got = shared.value
        voters = Voters(got[0]) if got else None
        return lambda text: not got or _one(voters, got, text) < at

    return keep_rows(docs, "text", start)
