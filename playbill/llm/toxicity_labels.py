"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posterior labels.

Voters are word lists of insults in four languages, patterns of typing, and words and word beginnings mined from labelled
rows (each at one, two and four uses in a text). The label model is a latent class model: for each voter, and for the
given label as one more voter, it estimates how often it fires on toxic and on clean texts, by expectation maximisation over the
distinct vote patterns; what voters still share within a class is their correlation, and correlated votes count for
less. The posteriors are the targets of a logistic regression over all mined terms, which then scores whole texts.

Everything that is fitted sees at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean rows, taken by a hash of doc_id from
labelled rows whose ``crc32(doc_id as text) mod 3`` is not 1. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts have no votes and get the score of the bias. Rows without a label, or with a null one, are not
learned from; without rows of both classes the word lists alone decide, with fixed weights. Of rows with equal text and label
one is learned from; every row is scored. Empty tables give no rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from playbill.llm.common import add_columns, binary, by_value, map_rows, tidy_words, written

by_value(__name__)

FIT_TOXIC, FIT_CLEAN = 8_000, 16_000
HELD_OUT = 1
THRESHOLD = 0.7
TERMS, VOTERS = 1500, 48
BEGINNINGS = range(3, 9)
USES = (1, 2, 4)
LEAST_ROWS, LEAST_SHARE, LEAST_Z = 5, 0.01, 4.0
LABEL_TRUST = 0.95
MEMORY = 300_000

# Common insults and slurs of contempt, by language.
LISTS = {
    "english": "idiot idiots moron morons stupid dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown imbecile bastard bitch asshole jerk "
               "creep freak filth filthy vermin parasite ugly fool foolish retard pig swine coward liar shut hate kill",
    "german": "idiot idioten dumm dummkopf depp trottel arsch arschloch schwein dreck abschaum versager wertlos erbärmlich widerlich clown lügner feigling hure bastard hasse",
    "french": "idiot idiote imbécile crétin débile abruti connard connasse salaud salope ordure déchet minable pathétique dégoûtant clown menteur lâche bâtard pute haine",
    "spanish": "idiota imbécil estúpido estúpida tonto tonta basura escoria inútil patético asqueroso payaso mentiroso cobarde cabrón puta mierda bastardo odio perdedor",
}
PATTERNS = ("capitals", "exclamations")


def typing(text: bytes) -> list[int]:
    """Patterns of typing: mostly capitals, many double exclamation marks."""
    letters = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return [int(letters * 2 > len(text) > 0), int(text.count(b"!!") >= 3)]


def terms_of(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"{word}$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def term_uses(words: list[bytes]) -> Counter:
    uses: Counter = Counter()
    for word, n in Counter(words).items():
        for term in terms_of(word.decode(errors="replace")):
            uses[term] += n
    return uses


# Rows to fit on.

def fit_rows(documents: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> DataFrame:
    """(text, toxic) of a bounded sample by class."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & (F.pmod(F.crc32(F.col("_id").cast("string").cast("binary")), F.lit(3)) != HELD_OUT))
    have = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    grain = 1 << 30
    share = F.when(F.col("toxic") == 1, F.lit(int(grain * min(1, toxic / max(1, have.get(1, 0)))))).otherwise(F.lit(int(grain * min(1, clean / max(1, have.get(0, 0))))))
    sample = usable.where(F.pmod(F.xxhash64("_id"), F.lit(grain)) < share)
    # At most about toxic + clean ids of eight bytes.
    return documents.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("text", "toxic").dropDuplicates()


def mined_terms(rows: DataFrame, most: int = TERMS) -> tuple[list[str], list[str]]:
    """Terms that occur in toxic rows far above their share, strongest first, and those of them that are precise enough to
    vote. Counts are summed in tasks, then by term."""
    def counted(batches):
        counts: dict[str, list[int]] = {}
        totals = [0, 0]

        def columns():
            return list(counts), [c[1] for c in counts.values()], [c[0] for c in counts.values()]

        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), binary(batch, "text")):
                totals[toxic] += 1
                for term, n in term_uses(tidy_words(text)).items():
                    for least in USES:
                        if n >= least:
                            counts.setdefault(f"{least}:{term}", [0, 0])[toxic] += 1
            if len(counts) > MEMORY:
                yield columns()
                counts.clear()
        counts[""] = totals
        yield columns()

    counts = map_rows(rows, "term string, toxic long, clean long", counted).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = written(counts.where((F.col("term") == "") | (F.col("toxic") >= LEAST_ROWS)), "term-counts")
    totals = counts.where("term = ''").first()
    if totals is None or not totals.toxic or not totals.clean:
        return [], []
    share = totals.toxic / (totals.toxic + totals.clean)
    seen = F.col("toxic") + F.col("clean")
    z = (F.col("toxic") - seen * share) / F.sqrt(seen * share * (1 - share))
    odds = F.log((F.col("toxic") + 0.5) * totals.clean / ((F.col("clean") + 0.5) * totals.toxic))
    strong = counts.where((F.col("term") != "") & (F.col("toxic") >= max(LEAST_ROWS, LEAST_SHARE * totals.toxic))).withColumns({"z": z, "gain": F.col("toxic") * odds}).where(
        (F.col("z") >= LEAST_Z) & (odds > 1))
    kept = [(r.term, r.toxic, r.clean) for r in strong.orderBy(F.desc("gain"), "term").limit(2 * most).toLocalIterator()]
    return unlike(kept)[:most], [t for t, toxic, clean in kept if toxic >= 4 * clean]


def unlike(counted: list[tuple[str, int, int]]) -> list[str]:
    """The terms, strongest first, without those that are beginnings of another with the same counts."""
    alike: dict[tuple, str] = {}
    for term, toxic, clean in counted:
        key = (term[:4], toxic, clean)
        if len(term) > len(alike.get(key, "")):
            alike[key] = term
    longest = set(alike.values())
    return [t for t, _, _ in counted if t in longest]


def varied(terms: list[str], most: int = VOTERS) -> list[str]:
    """The strongest terms of which none begins or continues another."""
    chosen: list[str] = []
    for term in terms:
        bare = term.partition(":")[2].rstrip("$")
        if not any(bare.startswith(c) or c.startswith(bare) for c in (x.partition(":")[2].rstrip("$") for x in chosen)):
            chosen.append(term)
        if len(chosen) >= most:
            break
    return chosen


# Votes and features of a text.

class Reader(dict):
    """Features of texts. As a mapping: for a word, the numbers of the stems (word lists and terms) it counts for."""

    def __init__(self, terms: list[str]):
        super().__init__()
        stems = dict.fromkeys([*(f"#{name}" for name in LISTS), *(t.partition(":")[2] for t in terms)])
        self.stems = {s: i for i, s in enumerate(stems)}
        self.lists = {name: frozenset(words.split()) for name, words in LISTS.items()}
        self.names = [f"{n}:#{name}" for name in LISTS for n in USES] + [*PATTERNS] + terms
        at = {name: i for i, name in enumerate(self.names)}
        self.features = [[(n, at[f"{n}:{s}"]) for n in USES if f"{n}:{s}" in at] for s in stems]
        self.patterns = [at[p] for p in PATTERNS]

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        text = word.decode(errors="replace")
        found = [self.stems[f"#{name}"] for name, words in self.lists.items() if text in words]
        found += [self.stems[t] for t in terms_of(text) if t in self.stems]
        if len(self) >= MEMORY:
            self.clear()
        self[word] = tuple(found)
        return self[word]

    def active(self, text: bytes) -> list[int]:
        """Numbers of the features that the text has."""
        uses = Counter([s for w in tidy_words(text) for s in self[w]])
        out = [i for s, n in uses.items() for least, i in self.features[s] if n >= least]
        return out + [i for i, on in zip(self.patterns, typing(text)) if on]


# The label model.

def label_posteriors(votes: np.ndarray, weights: np.ndarray, prior: float, rounds: int = 60) -> np.ndarray:
    """P(toxic) of each vote pattern (rows of 0/1, ``weights`` times seen), the last column being the given label.

    Expectation maximisation of a two-class latent model, started from the given label. A voter that does not fire
    abstains; the label always votes, and is right in LABEL_TRUST of either class at least (else the classes could drift). At the end the log odds of each voter are divided by one plus what it shares with the
    others within the classes (the sum of its residual correlations)."""
    v, total = votes.astype(float), weights.sum()

    def odds(fires: np.ndarray, share: np.ndarray) -> np.ndarray:
        against = np.log((1 - fires[1, -1]) / (1 - fires[0, -1]))
        return v @ (share * np.log(fires[1] / fires[0])) + (1 - v[:, -1]) * against + np.log(prior / (1 - prior))

    def sure(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    post = v[:, -1] * 0.9 + 0.05
    for _ in range(rounds):
        on, off = weights * post, weights * (1 - post)
        fires = np.clip(np.stack([(off @ v + 0.5) / (off.sum() + 1), (on @ v + 0.5) / (on.sum() + 1)]), 1e-4, 1 - 1e-4)
        fires[:, -1] = min(fires[0, -1], 1 - LABEL_TRUST), max(fires[1, -1], LABEL_TRUST)
        before, post = post, sure(odds(fires, np.ones(v.shape[1])))
        if np.abs(before - post).max() < 1e-4:
            break
    rest = v - (post[:, None] * fires[1] + (1 - post)[:, None] * fires[0])
    shared = (rest * weights[:, None]).T @ rest / total
    spread = np.sqrt(np.clip(np.diag(shared), 1e-9, None))
    correlation = shared / spread / spread[:, None]
    correlated = np.where(correlation > 0.1, correlation, 0).sum(0) - np.diag(correlation)
    return sure(odds(fires, 1 / (1 + np.clip(correlated, 0, None))))


def fit_linear(rows: list[list[int]], targets: np.ndarray, n: int, penalty: float = 0.1, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient steps; features are lists of active numbers."""
    flat = np.array([i for r in rows for i in r], np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    # Each weight's step is bounded by its curvature: a quarter of the lengths of the rows it is active in (and the bias).
    length = np.array([len(r) + 1 for r in rows], float)
    step = 1 / (0.25 * np.bincount(flat, length[owner], n) + penalty)
    bias_step = 1 / (0.25 * length.sum())
    weights, bias = np.zeros(n), float(np.log(targets.mean() / (1 - targets.mean())))
    ahead, bias_ahead, t = weights, bias, 1.0
    for _ in range(rounds):
        odds = bias_ahead + np.bincount(owner, ahead[flat], len(rows))
        error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - targets
        new = ahead - step * (np.bincount(flat, error[owner], n) + penalty * ahead)
        bias_new = bias_ahead - bias_step * error.sum()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = new + (t - 1) / t_new * (new - weights), bias_new + (t - 1) / t_new * (bias_new - bias)
        weights, bias, t = new, bias_new, t_new
    return weights, bias


@dataclass(frozen=True)
class Model:
    """Terms, and the weight of each of the reader's features."""

    terms: tuple[str, ...]
    weights: tuple[float, ...]
    bias: float


def listed_only() -> Model:
    """The word lists alone: a text with two listed words or more is toxic."""
    names = Reader([]).names
    return Model((), tuple({"1": 1.0, "2": 3.0, "4": 1.0}.get(n[0], 0.0) if ":" in n else 0.0 for n in names), -3.0)


def fit(documents: DataFrame, labels: DataFrame, toxic: int = FIT_TOXIC, clean: int = FIT_CLEAN) -> Model:
    rows = written(fit_rows(documents, labels, toxic, clean), "fit-rows")
    terms, precise = mined_terms(rows)
    ballot = {*varied([t for t in precise if t in set(terms)]), *PATTERNS}
    reader = Reader(terms)

    def read(batches):
        for batch in batches:
            yield batch.column("toxic"), [reader.active(t) for t in binary(batch, "text")]

    made = map_rows(rows, "toxic int, active array<int>", read).toLocalIterator()
    given, active = [], []
    for r in made:
        given.append(r.toxic)
        active.append(sorted(r.active))
    if not given or len(set(given)) < 2:
        return listed_only()
    voters = [i for i, name in enumerate(reader.names) if name in ballot or "#" in name]
    place = {f: k for k, f in enumerate(voters)}
    patterns = Counter((tuple(place[f] for f in a if f in place), g) for a, g in zip(active, given))
    votes = np.zeros((len(patterns), len(voters) + 1), np.int8)
    for k, (fired, g) in enumerate(patterns):
        votes[k, list(fired)] = 1
        votes[k, -1] = g
    prior = float(np.clip(np.mean(given), 0.01, 0.99))
    post = dict(zip(patterns, label_posteriors(votes, np.array(list(patterns.values()), float), prior)))
    targets = np.array([post[tuple(place[f] for f in a if f in place), g] for a, g in zip(active, given)])
    weights, bias = fit_linear(active, np.clip(targets, 0.005, 0.995), len(reader.names))
    return Model(tuple(terms), tuple(float(w) for w in weights), bias)


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with ``score``, 0 to 1."""
    table = documents.sparkSession.sparkContext.broadcast({"model": model})

    def run(batch):
        held = table.value
        if "reader" not in held:
            held["reader"] = Reader(list(held["model"].terms))
        reader, weights, bias = held["reader"], held["model"].weights, held["model"].bias
        odds = np.array([bias + sum(weights[i] for i in reader.active(t)) for t in binary(batch, "text")])
        return [(1 / (1 + np.exp(-np.clip(odds, -30, 30)))).tolist()]

    return add_columns(documents, "score double", run)


def clean_only(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score below the threshold."""
    model = fit(documents, labels)
    row = F.struct(*(documents[f"`{c}`"] for c in documents.columns)).alias("_row")
    return scored(documents.select(row, "text"), model).where(F.col("score") < THRESHOLD).select("_row.*")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    rows = scored(documents.select("doc_id", "text"), fit(documents, labels))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == HELD_OUT
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
