"""Operator 8: toxicity by a weighted finite-state pattern grammar.

Four small transducers read the word classes of a clause: *target* (is somebody
addressed), *threat* (a verb of violence with its object near), *negation* and
*report* (verbs of saying, words about words, quotation marks), whose effect ends
a few words on.  Their composition is one table over product states.  An insult
or a threat is put out by the arc that matches it, unless the state reached lies
in a negation's or a report's scope; what a clause put out is weighed as *aimed*
or as *plain* by the state in which the clause ends.  Denied and reported matches
weigh nothing, so negation and report never raise a score.

The insult lexicon is learned: words and word stems (first 3 to 8 letters)
that mark toxic documents in a bounded sample of labelled rows
(``TRAIN_TOXIC``, ``TRAIN_CLEAN``: ids with the smallest hashes, one text an id,
the last in code-point order).  A match weighs the log of how much likelier a
toxic document holds the term than a clean one of the same length holds as many
different words of it, so a chance match in a long text weighs little and a
repeated line no more than once; a word counts in its strongest clause.  A term needs ``LEAST`` documents with different words beside
it (copies of one text count once), however many labels there are.  A threat at
somebody weighs as the strongest insult, whether or not the labels show any.
The two coefficients come from the same rows by ridge-penalised logistic
regression and are kept in order: 0 <= plain <= aimed.  The words of the other
transducers are fixed values.

A document's score is ``1 / (1 + exp(-(b + plain sum + aimed sum)))``.  Rows:
NULL or empty texts match nothing and get the score of the bias alone; with no
labels of one kind, or no rows at all, the lexicon is empty and the score is near
the only label (near 0 without labels); an empty table gives no rows; repeated rows and ties score
alike; a row without an id is scored and not held out; long texts are read whole;
other columns are kept, the score takes a name that they don't have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import checked_broadcast, fold, fresh, saved

TRAIN_TOXIC, TRAIN_CLEAN = 4_000, 12_000
#: Most lifted terms read and kept, how many times likelier a toxic document must hold a
#: term, and the documents with different surroundings that it needs.
LIFTED_TERMS, KEPT_TERMS, LIFT, LEAST = 40_000, 2_000, 8, 3
STEMS = range(3, 9)
#: Most weight of one match, which is also the weight of a threat.
MOST_WEIGHT = 8.0
#: Words that a negation, a report and a verb of violence reach.
DENIES, REPORTS_ON, REACHES = 4, 6, 3

# Function words of the four languages and their marks.
TARGETS = "he she they er sie il elle ils elles él ella ellos ellas your yours ton votre"
OBJECTS = "you him her them toi vous lui leur ihn ihm ihnen usted ustedes vosotros"
CLITICS = "te vous dich dir euch os le les"
SUBJECTS = "tu du ihr"
NEGATIONS = "not no never none nor neither nobody isn't aren't don't wasn't nicht kein keine keiner nie niemals niemand pas jamais aucun personne nunca ningún jamás tampoco nadie"
REPORTS = "said says say told tells wrote writes called quoted reported claims word words term sagte sagt schrieb nannte wort wörter dit disait écrit appelé mot mots dijo dice escribió llamó palabra palabras"
THREATS = "kill hurt destroy murder töten umbringen schlagen verletzen tuer frapper détruire matar golpear destruir"
BUT = "but aber sondern mais pero sino"

PLAIN, INSULT, THREAT, TARGET, OBJECT, CLITIC, NEGATION, REPORT, NEXT = range(9)
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.,;:!?\n\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_BREAK = frozenset(".,;:!?\n")
_QUOTE = frozenset("\"“”«»")


@dataclass(frozen=True)
class Transducer:
    """Deterministic finite-state transducer over word classes; the state is its output."""
    states: int
    moves: dict = field(hash=False)  # (state, class) -> state; other input keeps the state

    def step(self, state: int, cls: int) -> int:
        return self.moves.get((state, cls), state)


def _scope(cls: int, words: int) -> Transducer:
    """Opened by a class, it counts down the words that it still reaches."""
    moves = {(k, c): max(k - 1, 0) for k in range(words + 2) for c in range(NEXT)}
    return Transducer(words + 2, {**moves, **{(k, cls): words + 1 for k in range(words + 2)}})


def _threat() -> Transducer:
    """States 1..REACHES wait for an object after the verb, the next ones for the verb after a
    clitic; the last is reached by a threat and left with the next word."""
    n = REACHES
    done = 2 * n + 1
    moves = {}
    for k in range(done + 1):
        waits, clitic = 0 < k <= n, n < k < done
        for c in range(NEXT):
            moves[k, c] = k - 1 if waits or (clitic and k > n + 1) else 0
        moves[k, CLITIC] = done if waits else 2 * n
        moves[k, THREAT] = done if clitic else n
        if waits:
            moves[k, OBJECT] = done
    return Transducer(done + 1, moves)


def grammar() -> dict[str, Transducer]:
    return {
        "target": Transducer(2, {(0, c): 1 for c in (TARGET, OBJECT, CLITIC)}),
        "threat": _threat(),
        "negation": _scope(NEGATION, DENIES),
        "report": _scope(REPORT, REPORTS_ON),
    }


def compose(parts: list[Transducer], classes: int = NEXT) -> np.ndarray:
    """Product automaton: ``table[state, class] -> state`` with states in mixed radix."""
    sizes = [p.states for p in parts]
    table = np.zeros((int(np.prod(sizes)), classes), np.int64)
    for s in range(len(table)):
        at = np.unravel_index(s, sizes)
        for c in range(classes):
            table[s, c] = np.ravel_multi_index([p.step(int(k), c) for p, k in zip(parts, at)], sizes)
    return table


_PARTS = grammar()
_SIZES = [p.states for p in _PARTS.values()]
_TABLE = compose(list(_PARTS.values())).tolist()
#: Match weights of a document by the end states of their clauses: all of them, and those of aimed clauses again.
FEATURES = ("matched", "aimed")
#: Per product state: is somebody addressed, is a threat complete, is a match here neither denied nor reported.
_AT = np.unravel_index(np.arange(len(_TABLE)), _SIZES)
AIMED, THREATENED, ASSERTED = (_AT[0] > 0).tolist(), (_AT[1] == _SIZES[1] - 1).tolist(), ((_AT[2] == 0) & (_AT[3] == 0)).tolist()


class Lexicon(dict):
    """Word -> class, by the learned terms and the fixed function words.

    ``terms``: term -> (share of toxic documents with it, its rate per word in clean ones).
    """

    def __init__(self, terms: dict, limit: int = 300_000):
        super().__init__()
        for cls, words in ((THREAT, THREATS), (TARGET, TARGETS), (TARGET, SUBJECTS), (OBJECT, OBJECTS), (CLITIC, CLITICS),
                           (NEGATION, NEGATIONS), (REPORT, REPORTS), (NEXT, BUT)):
            self.update(dict.fromkeys(words.split(), cls))
        self.terms, self.room = terms, len(self) + limit

    def term(self, word: str) -> str | None:
        """The word itself or its longest learned stem."""
        if word + "$" in self.terms:
            return word + "$"
        return next((word[:k] + "*" for k in reversed(STEMS) if len(word) > k and word[:k] + "*" in self.terms), None)

    def weight(self, term: str, n: int, forms: int) -> float:
        """Log of how much likelier a toxic document holds ``forms`` words of the term than ``n`` clean words do."""
        toxic, rate = self.terms[term]
        chance = rate * n
        if forms == 0 or chance >= forms:
            return 0.0
        part = total = np.exp(-chance) * np.prod(chance / np.arange(1, forms + 1))  # of the Poisson tail
        while part > 1e-12 * total:
            forms += 1
            part *= chance / forms
            total += part
        return min(max(float(np.log(toxic) - np.log(max(total, 1e-300))), 0.0), MOST_WEIGHT)

    def __missing__(self, word: str) -> int:
        cls = INSULT if self.term(word) else PLAIN
        if len(self) < self.room:
            self[word] = cls
        return cls


def matches(text: str | None, lexicon: Lexicon) -> tuple[dict[str, bool], int]:
    """Matched insults and threats of a whole text, each with whether one of its clauses is aimed, and the number of words."""
    found: dict[str, bool] = {}
    low = (text or "").lower()
    words = _WORD.findall(low)
    if {INSULT, THREAT}.isdisjoint(map(lexicon.__getitem__, words)):
        return found, len(words)  # no clause can match
    state, quoted, out = 0, False, []

    def end() -> None:
        for word in out:
            found[word] = found.get(word, False) or AIMED[state]
        out.clear()

    for token in _TOKEN.findall(low):
        if token in _QUOTE:
            quoted = not quoted
            continue
        cls = NEXT if token in _BREAK else lexicon[token]
        if cls == NEXT:
            end()
            state, quoted = 0, quoted and token != "\n"
            continue
        state = _TABLE[state][cls]
        if quoted or not ASSERTED[state]:
            continue
        if cls == INSULT:
            out.append(token)
        elif THREATENED[state]:
            out.append(A_THREAT)
    end()
    return found, len(words)


#: Stands for a threat among the matched words (no word is empty).
A_THREAT = ""


def clause_features(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """The weights of the matched terms summed, by all their words and by those of aimed clauses."""
    found, n = matches(text, lexicon)
    out = np.zeros(len(FEATURES))
    for i, words in enumerate((found, [w for w, aimed in found.items() if aimed])):
        forms = Counter(lexicon.term(w) for w in words if w != A_THREAT)
        out[i] = sum(lexicon.weight(t, n, k) for t, k in forms.items()) + MOST_WEIGHT * (A_THREAT in words)
    return out


def _terms(text: str | None) -> set[str]:
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    return {w + "$" for w in words if len(w) > 2} | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _beside(text: str | None) -> dict[str, int]:
    """Terms of a text and the hash of the words around the first match of each."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    out: dict[str, int] = {}
    seen = set()
    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
        if w not in seen:
            seen.add(w)
            around = xxhash.xxh64_intdigest(f"{before} {after}") >> 1
            if len(w) > 2:
                out.setdefault(w + "$", around)
            for k in STEMS:
                if len(w) > k:
                    out.setdefault(w[:k] + "*", around)
    return out


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [x for t in b.column(0) for x in _beside(t.as_py()).items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "around"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term; under the empty term, the number of words."""
    for b in batches:
        count: dict = {"": 0}
        for t in b.column(0):
            text = t.as_py()
            count[""] += len(_WORD.findall((text or "").lower()))
            for x in _terms(text):
                count[x] = count.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "clean_hits"])


def _held_terms(terms: set):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(_terms(t.as_py()) & terms) for t in b.column(0)], pa.list_(pa.string()))], names=["terms"])
    return run


def cover(held: list[set], cost: dict[str, float], least: int, often: float) -> tuple:
    """Greedy set cover: the term that marks most documents not yet marked, less
    five times its clean documents at equal numbers; the longest of equals, so a stem is
    as specific as its documents allow.  Ends below ``least`` new documents, so
    words that only some copies of one text share don't enter.  Terms that the
    cover didn't need follow if no clean document holds them, ``often`` toxic ones do,
    and they stand beside many different sets of covering terms, which copies of one
    text don't."""
    where: dict = {}
    for i, terms in enumerate(held):
        for t in terms:
            where.setdefault(t, set()).add(i)
    full = dict(where)
    out, todo = [], set(range(len(held)))
    while len(out) < KEPT_TERMS and where:
        gain = {t: len(d & todo) - 5 * cost[t] for t, d in where.items()}
        best = max(gain, key=lambda t: (gain[t], len(t.rstrip("$*")), t))
        if gain[best] < least:
            break
        out.append(best)
        todo -= where.pop(best)
        where = {t: d for t, d in where.items() if gain[t] >= least}
    beside = [frozenset(t for t in out if i in full[t]) for i in range(len(held))]
    more = [t for t, d in full.items() if len(d) >= often and not cost[t] and len({beside[i] for i in d}) >= len(d) ** 0.5]
    alike: dict = {}
    for t in sorted(more, key=lambda t: (len(t.rstrip("$*")), t)):
        alike[frozenset(full[t])] = t  # the longest of terms with the same documents
    more = alike.values()
    return tuple(out + sorted(set(more).difference(out))[:KEPT_TERMS - len(out)])


def _features(terms):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(terms)
        for b in batches:
            rows = [clause_features(t.as_py(), lexicon) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tolist() for r in rows], pa.list_(pa.float64()))], names=["key", "f"])
    return run


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Newton's method; the penalty spares the bias (last)."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, pen = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pen + 1e-9), x.T @ (y - p) - pen * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic regression with weights of 0 or more: the most negative goes, until none is."""
    use = list(range(x.shape[1]))
    while True:
        w = _newton(x[:, use], y, ridge)
        if not use or w[:-1].min() >= 0:
            out = np.zeros(x.shape[1] + 1)
            out[[*use, -1]] = w
            return out
        del use[int(w[:-1].argmin())]


@dataclass(frozen=True)
class ToxicityModel:
    terms: dict
    weights: tuple  # one per feature, then the bias

    def score(self, text: str | None, lexicon: Lexicon) -> float:
        f = clause_features(text, lexicon)
        return float(1 / (1 + np.exp(-np.clip(f @ np.array(self.weights[:-1]) + self.weights[-1], -30, 30))))


def fit(docs: DataFrame, labelled: DataFrame) -> ToxicityModel:
    """``labelled``: (doc_id, toxic); the caller leaves out what must not be seen."""
    clean = labelled.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    pick = [clean.where(f"toxic = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    sample = saved(pick[0].union(pick[1]), "toxicity_ids")
    # one row an id, so the rows stay within the bound whatever repeats
    texts = docs.select("doc_id", "text").join(checked_broadcast(sample, 32), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    texts = saved(texts, "toxicity_train")
    n = {r["toxic"]: r["k"] for r in texts.groupBy("toxic").agg(F.count("*").alias("k")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel({}, (0.0,) * len(FEATURES) + (30.0 if n1 else -30.0,))
    toxic, clean = (texts.where(f"toxic = {y}").select("text") for y in (1, 0))
    around = toxic.mapInArrow(_surroundings, "term string, around long").groupBy("term").agg(F.count("*").alias("hits"), F.countDistinct("around").alias("places"))
    counts = clean.mapInArrow(_term_counts, "term string, clean_hits long").groupBy("term").agg(F.sum("clean_hits").alias("clean_hits"))
    counts = saved(around.join(counts, "term", "full").fillna(0, ["hits", "places", "clean_hits"]), "toxicity_terms")
    lifted = counts.where((F.col("term") != "") & (F.col("places") >= LEAST) & (F.col("clean_hits") * LIFT * n1 <= F.col("places") * n0))
    lifted = {r["term"]: r for r in lifted.orderBy(F.desc("places"), "term").limit(LIFTED_TERMS).collect()}
    tested, n_words = counts.agg(F.count_if(F.col("places") >= LEAST), F.max(F.when(F.col("term") == "", F.col("clean_hits")))).first()
    # a term that no clean document holds is no chance find among all that were tested
    often = max(LEAST, np.log(max(tested, 1) / 0.01) / np.log((n1 + n0) / n1))
    held = toxic.mapInArrow(_held_terms(set(lifted)), "terms array<string>").collect()  # TRAIN_TOXIC rows at most
    terms = cover([set(r[0]) for r in held], {t: r["clean_hits"] * n1 / n0 for t, r in lifted.items()}, LEAST, often)
    terms = {t: (lifted[t]["hits"] / (n1 + 1), (lifted[t]["clean_hits"] + 0.5) / (n_words + 1)) for t in terms}
    rows = texts.select(F.col("toxic").cast("long").alias("toxic"), "text").mapInArrow(_features(terms), "key long, f array<double>").collect()
    x, y = np.array([r["f"] for r in rows]), np.array([r["key"] for r in rows], float)
    return ToxicityModel(terms, tuple(float(w) for w in _logistic(x, y)))


def _scores(model: ToxicityModel, text: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.terms)
        for b in batches:
            s = pa.array([model.score(t.as_py(), lexicon) for t in b.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], names=[*b.schema.names, name])
    return run


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` (which needs ``text``) and the score under a name that ``docs`` doesn't have."""
    return docs.mapInArrow(_scores(model, docs.columns.index("text"), name), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def clean(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below 0.5, all columns."""
    name = fresh(docs, "score")
    return score(docs, fit(docs, labelled.where(fold(F.col("doc_id"), 5) != 0)), name).where(F.col(name) < 0.5).drop(name)


def toxicity(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row; rows whose id falls in fold 0 of 5 are held out of training."""
    model = fit(docs, labelled.where(fold(F.col("doc_id"), 5) != 0))
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("score"),
                      F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
