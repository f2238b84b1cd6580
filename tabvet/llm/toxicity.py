"""Toxicity by a weighted finite-state pattern grammar over clauses.

A text is read as a string of symbols: word classes (insult, slur, threat, target, will, not, says, word) and punctuation;
slurs are insults that were learnt. Small transducers are composed into one machine, each reading what the one before it
writes:

* negation turns an insult, slur or threat within three words after a negation into a denied one;
* reported speech marks clauses with a verb of saying, and all clauses of the quotation that it opens;
* target marks clauses that speak to or of someone;
* insult and slur mark clauses that hold one, several slurs, or only denied ones;
* threat marks clauses in which a threat meets a target after it, `meant` if words of intent came before.

At the end of a clause the machine writes its marks; single words score nothing. A mark's weight and the intercept are
those of a logistic regression on log(1 + clauses with the mark), shrunk towards `WEIGHTS`, so a mark that the labelled
rows do not show keeps its given weight.

The lexicon is a short list in four languages plus words and stems (beginnings that several words share) learnt from the
labels: one becomes a slur if it occurs in enough different contexts (the words beside it) of toxic rows, hardly in
other rows, and if its contexts are nearly as many as its occurrences, so the words of near copies with one label are not
learnt; a listed insult that the labels contradict is left out. Slurs are tried on the rows that taught them, so a text
with a single one keeps a low given weight (`lone slur`): it may be chance. Fitting uses a bounded sample of labelled rows
(`SAMPLE`, smallest hashes of the id) outside the held-out fold (crc32(doc_id as text) mod 3 is 1); its labels are
broadcast, so texts are never shuffled.

Defined results: null text counts as empty, and empty texts, or texts without marks, score the intercept; labels that
are null or other than 0 and 1 are not used, of repeated labels of a document the largest counts; without labels the
given weights score; repeated rows get equal scores; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabvet.llm.common import fold, read, text_or_empty
from tabvet.session import materialize

FOLDS, HELD = 3, 1
THRESHOLD = 0.7
SAMPLE = 20_000
CONTEXTS, PURITY, SPREAD = 10, 0.95, 0.5
STEMS, KIN = range(3, 9), 3  # lengths of a stem, and how many words must share it
LEARNT = 5_000

INSULTS = """
idiot idiots idiotic moron morons stupid dumb dumbass imbecile cretin fool loser losers scum trash garbage clown pathetic worthless
disgusting vermin filth bastard bastards asshole bitch jerk freak creep coward liar scumbag lowlife degenerate
dummkopf trottel depp arschloch abschaum versager widerlich erbärmlich blödmann schwachkopf idiotisch dreckskerl
imbécile crétin connard connasse salaud ordure minable abruti débile dégoûtant racaille
idiota imbécil estúpido estúpida basura escoria inútil patético asqueroso cabrón payaso
"""
THREATS = """
kill hurt destroy beat shoot stab murder strangle burn crush smash attack punish
töten umbringen schlagen erschießen vernichten verletzen
tuer frapper détruire écraser égorger
matar golpear destruir aplastar disparar
"""
TARGETS = """
you your yours u ya he him she her they them their these those
du dich dir dein deine ihr euch sie er ihm ihn
tu te toi ton ta vous votre il elle ils elles leur
tú ti usted ustedes él ella ellos ellas vosotros
"""
INTENT = "will shall gonna going must should i'll we'll werde werden will muss vais allons va doit voy vamos debe"
NEGATIONS = "not no never without neither nor nobody nicht kein keine keinen nie niemals ohne ne pas jamais sans sin nunca ni"
SAYING = """
said says say saying told tells called calls wrote writes quoted claimed claims stated reported alleged according
sagte sagt nannte schrieb behauptete laut
dit disait appelait écrit selon
dijo dice llamó escribió según
"""

#: Given weights of the marks, for log(1 + clauses), and of the intercept.
WEIGHTS = {
    "insult": 6.0, "insult aimed": 7.0, "insult reported": 3.0, "insult aimed reported": 3.0, "denied": 0.0,
    "slur": 4.0, "slurs": 6.0, "lone slur": 1.0, "slur reported": 4.0, "slur denied": 3.0, "threat": 5.0, "threat meant": 7.0, "threat reported": 2.0,
}
INTERCEPT = -3.0
FIXED = {"lone slur"}

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;,:\n\"“”„«»]")
LETTERS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
BREAK = dict.fromkeys(".!?;", ".") | {",": ",", ":": ":", "\n": "\n"} | dict.fromkeys('"“”„«»', '"')

Arcs = dict[tuple[str, str], tuple[str, str]]


class Transducer:
    """Arcs (state, symbol) -> (state, output). Of other symbols, `other` names the next state and the symbol is kept.

    Symbols that begin with a dot end a clause; arcs for "." hold for all of them, and what the arc writes after its dot is
    added to the symbol."""

    def __init__(self, start: str, arcs: Arcs, other: dict[str, str] | None = None):
        self.start, self.arcs, self.other = start, arcs, other or {}

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        if symbol.startswith(".") and (state, ".") in self.arcs:
            state, out = self.arcs[state, "."]
            return state, symbol + out[1:]
        return self.arcs.get((state, symbol)) or (self.other.get(state, state), symbol)


def negation(reach: int = 3) -> Transducer:
    arcs: Arcs = {}
    for k in range(reach + 1):
        arcs[str(k), "not"] = str(reach), "word"
        arcs |= {(str(k), mark): ("0", mark) for mark in (",", ":", ".", "\n", '"')}
        if k:
            arcs |= {(str(k), "insult"): (str(k), "denied"), (str(k), "threat"): (str(k), "denied"), (str(k), "slur"): (str(k), "denied slur")}
    return Transducer("0", arcs, {str(k): str(max(0, k - 1)) for k in range(reach + 1)})


REPORTED = Transducer(
    "plain",
    {
        ("plain", "says"): ("says", "word"), ("plain", ":"): ("plain", "."), ("plain", "\n"): ("plain", "."),
        ("says", ":"): ("colon", ". reported"), ("says", '"'): ("quoted", "word"), ("says", "."): ("plain", ". reported"), ("says", "\n"): ("plain", ". reported"),
        ("colon", '"'): ("quoted", "word"), ("colon", "."): ("colon", ". reported"), ("colon", ":"): ("colon", "word"), ("colon", "\n"): ("plain", ". reported"),
        ("quoted", '"'): ("says", "word"), ("quoted", "."): ("fresh", ". reported"), ("quoted", ":"): ("quoted", "word"), ("quoted", "\n"): ("plain", ". reported"),
        ("fresh", '"'): ("plain", "word"), ("fresh", "."): ("fresh", ". reported"), ("fresh", ":"): ("quoted", "word"), ("fresh", "\n"): ("plain", "."),
    },
    {"fresh": "quoted"},
)
TARGET = Transducer("none", {("none", "target"): ("some", "target"), ("some", "."): ("none", ". aimed")})
INSULT = Transducer(
    "none",
    {
        ("none", "insult"): ("insult", "insult"), ("denied", "insult"): ("insult", "insult"), ("none", "denied"): ("denied", "denied"),
        ("insult", "."): ("none", ". insult"), ("denied", "."): ("none", ". denied"),
    },
)
SLUR = Transducer(
    "none",
    {
        ("none", "slur"): ("one", "slur"), ("none", "denied slur"): ("denied", "denied slur"),
        ("one", "slur"): ("many", "slur"), ("one", "denied slur"): ("many", "denied slur"), ("denied", "slur"): ("many", "slur"),
        ("one", "."): ("none", ". slur"), ("many", "."): ("none", ". slurs"), ("denied", "."): ("none", ". unslur"),
    },
)
THREAT = Transducer(
    "none",
    {
        ("none", "will"): ("will", "will"), ("none", "threat"): ("bare", "threat"), ("will", "threat"): ("set", "threat"),
        ("bare", "target"): ("threat", "target"), ("set", "target"): ("meant", "target"),
        ("threat", "."): ("none", ". threat"), ("meant", "."): ("none", ". meant"),
        ("will", "."): ("none", "."), ("bare", "."): ("none", "."), ("set", "."): ("none", "."),
    },
)


class Composed:
    """The machines one after the other, as one machine whose arcs are made when first taken."""

    def __init__(self, machines: Iterable[Transducer]):
        self.machines = list(machines)
        self.start = tuple(m.start for m in self.machines)
        self.arcs: dict = {}

    def step(self, state: tuple, symbol: str) -> tuple[tuple, str]:
        if (found := self.arcs.get((state, symbol))) is None:
            after, out = [], symbol
            for machine, s in zip(self.machines, state):
                s, out = machine.step(s, out)
                after.append(s)
            found = self.arcs[state, symbol] = tuple(after), out
        return found


def grammar() -> Composed:
    return Composed([negation(), REPORTED, TARGET, INSULT, SLUR, THREAT])


def marks_of(clause: str) -> list[str]:
    """The marks that a clause's final symbol stands for."""
    flags = clause.split()
    aimed, reported = "aimed" in flags, "reported" in flags
    found = []
    if "insult" in flags:
        found.append("insult" + " aimed" * aimed + " reported" * reported)
    elif "denied" in flags:
        found.append("denied")
    if "slur" in flags or "slurs" in flags:
        found.append("slur reported" if reported else "slurs" if "slurs" in flags else "slur")
    elif "unslur" in flags:
        found.append("slur denied")
    if "threat" in flags or "meant" in flags:
        found.append("threat reported" if reported else "threat meant" if "meant" in flags else "threat")
    return found


class Lexicon:
    """Word classes: the given lists less the contradicted insults, and learnt slurs (words, or stems that end in *)."""

    def __init__(self, learnt: Iterable[str] = (), contradicted: Iterable[str] = ()):
        learnt, contradicted = set(learnt), set(contradicted)
        classes: dict[str, str] = {}
        for name, words in (("says", SAYING), ("target", TARGETS), ("will", INTENT), ("not", NEGATIONS), ("threat", THREATS), ("insult", INSULTS)):
            classes |= dict.fromkeys(words.split(), name)
        classes = dict.fromkeys((w for w in learnt if not w.endswith("*")), "slur") | classes
        self.classes = {w: c for w, c in classes.items() if c != "insult" or w not in contradicted}
        self.stems = frozenset(w[:-1] for w in learnt if w.endswith("*"))
        self.lengths = sorted({len(s) for s in self.stems})
        self.marked = frozenset(w for w, c in self.classes.items() if c in ("insult", "slur", "threat"))

    def stemmed(self, word: str) -> bool:
        return any(word[:n] in self.stems for n in self.lengths)

    def marks(self, text: str) -> bool:
        """Does the text hold any insult, slur or threat?"""
        words = set(LETTERS.findall(text.lower()))
        return not self.marked.isdisjoint(words) or any(not self.stems.isdisjoint([w[:n] for w in words]) for n in self.lengths)

    def symbol(self, token: str) -> str:
        if token in BREAK:
            return BREAK[token]
        word = token.lower().replace("’", "'")
        return self.classes.get(word) or ("not" if word.endswith("n't") else "slur" if self.stemmed(word) else "word")


def clauses(text: str, lexicon: Lexicon, machine: Composed) -> list[tuple[int, int, str]]:
    """(start, end, mark) of the matched clauses of a whole text, offsets in code points."""
    if not lexicon.marks(text):
        return []
    found, state, start, end = [], machine.start, None, 0
    for m in TOKEN.finditer(text):
        state, out = machine.step(state, lexicon.symbol(m[0]))
        if start is None:
            start = m.start()
        if out.startswith("."):
            found += [(start, m.end(), mark) for mark in marks_of(out)]
            start = None
        end = m.end()
    _, out = machine.step(state, "\n")
    return found + [(start or 0, end, mark) for mark in marks_of(out) if start is not None]


def features(marks: Iterable[str]) -> np.ndarray:
    of = Counter(marks)
    if of["slur"] == 1 and not of["slurs"] + of["slur reported"] + of["slur denied"]:
        of["slur"], of["lone slur"] = 0, 1
    return np.log1p([of[name] for name in WEIGHTS])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, pull: float = 1.0) -> np.ndarray:
    """Weights and, last, the intercept by Newton steps; `pull` draws the weights to the given ones."""
    centre = np.array([*WEIGHTS.values(), INTERCEPT])
    w, x = centre.copy(), np.hstack([x, np.ones((len(x), 1))])
    strength = np.array([pull * (1e6 if name in FIXED else 1) for name in [*WEIGHTS, "intercept"]])

    def risk(v: np.ndarray) -> float:
        z = x @ v
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (strength * (v - centre) ** 2).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) + strength * (w - centre)
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(strength), g)
        size = 1.0
        while size > 1e-4 and risk(w - size * move) > risk(w):
            size /= 2
        w = w - size * move
        if np.abs(move).max() < 1e-8:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """text, toxic of at most `limit` labelled rows' ids outside the held-out fold, stored."""
    known = labels.select(F.col("doc_id").cast("long"), "toxic").where("toxic in (0, 1) and doc_id is not null")
    known = known.where(fold("doc_id", FOLDS) != HELD).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id", F.lit(13)), "doc_id").limit(limit)  # `limit` rows of 12 bytes: small enough to broadcast
    return materialize(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))


def evidence(sample: DataFrame) -> tuple[list[str], list[str]]:
    """(learnt, contradicted) words of the sample."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}'’]+"), lambda w: F.length(w) > 2)
    pairs = sample.select("toxic", words.alias("w")).select(
        "toxic", F.explode(F.expr("transform(w, (x, i) -> struct(x AS word, xxhash64(get(w, i - 1), get(w, i + 1)) AS context))")).alias("p")
    )
    contexts = pairs.groupBy("p.word", "p.context").agg(F.sum("toxic").alias("ones"), F.sum(1 - F.col("toxic")).alias("zeros"))
    seen = materialize(contexts.groupBy("word").agg(
        F.count_if(F.col("ones") > 0).alias("bad"), F.count_if(F.col("zeros") > 0).alias("good"),
        F.sum("ones").alias("occurrences"),
    ))
    sums = [F.sum(c).alias(c) for c in ("bad", "good", "occurrences")]
    listed = F.col("word").isin(INSULTS.split())
    stems = seen.where(~listed).select("bad", "good", "occurrences", F.explode(F.array(*[F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEMS])).alias("word"))
    stems = stems.where("word is not null").groupBy("word").agg(*sums, F.count(F.lit(1)).alias("kin")).where(F.col("kin") >= KIN).drop("kin")
    units = seen.select(*stems.columns).unionByName(stems.withColumn("word", F.concat("word", F.lit("*"))))
    units = units.withColumn("purity", F.col("bad") / (F.col("bad") + F.col("good")))
    learnt = units.where(~listed & (F.col("bad") >= CONTEXTS) & (F.col("purity") >= PURITY) & (F.col("bad") >= SPREAD * F.col("occurrences")))
    learnt = learnt.orderBy(F.desc("bad"), "word").limit(LEARNT).select("word", F.lit(True).alias("add"))
    enough = F.col("bad") + F.col("good") >= CONTEXTS
    contradicted = units.where(listed & enough & (F.col("purity") < 0.5)).select("word", F.lit(False).alias("add"))
    found = learnt.unionByName(contradicted).collect()
    return sorted(r.word for r in found if r["add"]), sorted(r.word for r in found if not r["add"])


MARKED = "array<struct<start: long, end: long, mark: string>>"
ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("mark", pa.string())]))


def per_text(rows: DataFrame, lexicon: Lexicon, name: str, kind: str, score: Callable[[list[str]], float]) -> DataFrame:
    """The first column of rows(key, text), as `name`, the score of each text's marks and its matched clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar()
        for batch in batches:
            found = [clauses(t.as_py(), lexicon, machine) for t in batch.column(1)]
            scores = pa.array([score([c[2] for c in of]) for of in found], pa.float64())
            spans = pa.array([[dict(zip(("start", "end", "mark"), c)) for c in of] for of in found], ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, spans], [name, "score", "clauses"])

    return rows.mapInArrow(run, f"{name} {kind}, score double, clauses {MARKED}")


class Model:
    """Lexicon and weights learnt from labelled rows."""

    def __init__(self, docs: DataFrame, labels: DataFrame, limit: int = SAMPLE):
        sample = labelled_sample(docs, labels, limit)
        self.lexicon = Lexicon(*evidence(sample))
        marked = per_text(sample.select("toxic", "text"), self.lexicon, "toxic", "int", lambda marks: 0.0)
        # rows with equal marks count together: what reaches the driver is a row for each different set of marks
        counted = marked.groupBy("toxic", F.array_sort(F.col("clauses.mark")).alias("marks")).count().collect()
        self.weights = np.array([*WEIGHTS.values(), INTERCEPT])
        if counted:
            x = np.repeat(np.stack([features(r.marks) for r in counted]), [r["count"] for r in counted], axis=0)
            self.weights = fit_logistic(x, np.repeat([r.toxic for r in counted], [r["count"] for r in counted]))

    def score(self, marks: list[str]) -> float:
        return float(1 / (1 + np.exp(-(features(marks) @ self.weights[:-1] + self.weights[-1]))))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted and the matched clauses of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    model = Model(rows, labels, limit)
    scored = per_text(rows, model.lexicon, "doc_id", "long", model.score)
    held_out = (fold("doc_id", FOLDS) == HELD).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), "clauses")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("clauses").cast("long").alias("n_clauses"))
