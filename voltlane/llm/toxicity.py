"""Operator 7: toxicity from a lexicon trie intersected with Levenshtein automata, weighed by context.

The lexicon is learned: words, and beginnings of words, that stand almost only in documents labelled toxic. Words and
beginnings form one trie. A word of a text is matched by running it through the automaton of the trie with a few
edits, whose states are sets of (trie node, edits so far); states and steps are built when first met and kept, so that
a word costs one look-up a letter. Longer terms allow more edits. A hit carries the share of toxic documents among
those with such a term; a misspelled hit the share measured for its number of edits. Around each hit a window of words
is scored: quotation marks and words of report speak for a quotation, the second person for abuse; a quotation counts
less by a measured factor. The score of a document is the chance that at least one hit is abuse.

Learning counts every distinct text once for each class, however many labelled copies it has, and reads at most
`MOST_LABELLED` distinct labelled texts of each class (a bounded, documented sample: those with the smallest digest of
the text). Terms are chosen from all candidates before at most `MOST_TERMS` are kept. Scoring reads every whole text.
Null and empty texts have no hits and get the score `NO_HIT`. Without labels of both classes the lexicon is empty.
Repeated rows get equal scores. Extra columns pass through; the score takes a name that clashes with none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Mapping
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltlane.llm.common import Stages, col, fresh, register, remainder, slices, table, tidy, with_fields

MOST_LABELLED = 8_000
MOST_TERMS = 2_000
#: A term must have this chance of a toxic text, smoothed, and stand in so many, and such a part, of the toxic texts.
LEAST_CHANCE, LEAST_DOCUMENTS, LEAST_PART = 0.9, 4, 0.01
#: Terms are taken from the most frequent; each must explain so many, and such a part, of the toxic texts without a term so
#: far, or share at most such a part of its texts with any one term kept. The words of near-copies of a text share nearly all,
#: so they bring in few terms; exact copies are one text.
LEAST_NEW, LEAST_NEW_PART, MOST_SHARED = 2, 0.001, 0.8
PREFIXES = range(4, 8)
#: Letters that a term needs for one and for two edits.
ONE_EDIT, TWO_EDITS = 5, 9
NO_HIT = 0.01
WINDOW = 6
#: Share of abuse taken for quoted hits and for misspelled ones before any is counted, and its weight in documents.
PRIOR = {"quoted": 0.3, 1: 0.75, 2: 0.5}
PRIOR_WEIGHT = 10
_WORD = re.compile(r"\w+")
_KEPT_WORDS = 300_000
_KEPT_STATES = 200_000
_QUOTES = "\"'“”„‟«»‹›‘’`"
REPORT = frozenset(
    "said says wrote writes called calls quote quoted word term insult slur sagte schrieb nannte wort zitat dit écrit appelé mot citation "
    "dijo escribió llamó palabra cita".split()
)
SECOND_PERSON = frozenset("you your youre u du dich dir dein euch ihr tu toi te vous votre ton ta tú ti usted ustedes tus".split())


class Hit(NamedTuple):
    chance: float
    edits: int
    term: str


class Lexicon(NamedTuple):
    """Terms with the chance of a toxic document; beginnings of words end in `*`.

    `by_edits` has what remains of a term's chance after so many edits, where that was measured.
    """

    terms: Mapping[str, float]
    by_edits: Mapping[tuple[str, int], float]
    quoted: float


class Matcher:
    """The automaton of a lexicon trie with edits, made as far as the words met so far need it."""

    def __init__(self, lexicon: Lexicon):
        self.by_edits = lexicon.by_edits
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, float] = {}
        self.prefix: dict[int, float] = {}
        self.own_edits: dict[int, int] = {}
        self.name: dict[int, str] = {}
        self.allowed: list[int] = [0]
        for term, chance in lexicon.terms.items():
            open_end, letters = term.endswith("*"), term.removesuffix("*")
            edits = 0 if open_end else (len(letters) >= ONE_EDIT) + (len(letters) >= TWO_EDITS)
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)  # of any term at or below the node
            (self.prefix if open_end else self.term)[node] = chance
            self.name[node] = letters
            if not open_end:
                self.own_edits[node] = edits
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, Hit | None] = {}
        self.steps: dict[tuple[int, str], int] = {}
        self.ids: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.accepts: list[Hit | None] = []
        self.begins: list[Hit | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """With letters of the lexicon left out: a node's children at one edit more."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node, e) < e:
                continue
            for child in self.children[node].values():
                if e < self.allowed[child] and nodes.get(child, 99) > e + 1:
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(key)
            whole = [Hit(self.term[n] * (self.by_edits.get((self.name[n], e), PRIOR[e]) if e else 1.0), e, self.name[n]) for n, e in key if n in self.term and e <= self.own_edits[n]]
            begun = [Hit(self.prefix[n], 0, self.name[n]) for n, e in key if n in self.prefix and not e]
            self.accepts.append(max(whole, default=None))
            self.begins.append(max(begun, default=None))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        out: dict[int, int] = {}
        for node, e in self.states[state]:
            below = self.children[node]
            if (child := below.get(c)) is not None and out.get(child, 99) > e:
                out[child] = e
            if e < self.allowed[node]:
                if out.get(node, 99) > e + 1:  # a letter too many
                    out[node] = e + 1
                for child in below.values():  # another letter
                    if e < self.allowed[child] and out.get(child, 99) > e + 1:
                        out[child] = e + 1
        return self._state(self._closed(out))

    def match(self, word: str) -> Hit | None:
        if word in self.words:
            return self.words[word]
        if len(self.words) > _KEPT_WORDS or len(self.states) > _KEPT_STATES:
            self._forget()
        state, best = self.start, None
        for c in word:
            if (after := self.steps.get((state, c))) is None:
                after = self.steps[(state, c)] = self._step(state, c)
            state = after
            if not self.states[state]:
                break
            if self.begins[state] and (best is None or self.begins[state] > best):
                best = self.begins[state]
        if (whole := self.accepts[state]) and (best is None or whole > best):
            best = whole
        self.words[word] = best
        return best


def hits_of(text: str, matcher: Matcher) -> list[tuple[str, Hit, float]]:
    """(word, hit, chance that it is a quotation) of every hit in a text."""
    lower = text.lower()
    if not any([matcher.match(w) for w in set(_WORD.findall(lower))]):
        return []
    spans = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(lower)]
    out = []
    for i, (word, start, end) in enumerate(spans):
        if hit := matcher.match(word):
            around = [w for w, _, _ in spans[max(0, i - WINDOW) : i] + spans[i + 1 : i + 1 + WINDOW]]
            left = lower[spans[max(0, i - WINDOW)][1] : start]
            right = lower[end : spans[min(len(spans) - 1, i + WINDOW)][2]]
            out.append((word, hit, quotation(left, right, around)))
    return out


def quotation(left: str, right: str, around: Iterable[str]) -> float:
    """Between 0 (abuse) and 1 (quotation), from the marks and words of the window."""
    around = set(around)
    near = bool(left.rstrip()[-1:]) and left.rstrip()[-1] in _QUOTES and right.lstrip()[:1] != "" and right.lstrip()[0] in _QUOTES
    inside = any(q in left for q in _QUOTES if q not in "'’") and any(q in right for q in _QUOTES if q not in "'’")
    score = 0.6 * near + 0.4 * (inside and not near) + 0.4 * bool(around & REPORT) - 0.4 * bool(around & SECOND_PERSON)
    return min(1.0, max(0.0, score))


def score_of(text: str | None, matcher: Matcher, lexicon: Lexicon) -> float:
    clean = 1.0 - NO_HIT
    seen: dict[str, float] = {}
    for word, hit, quoted in hits_of(text or "", matcher):
        abuse = hit.chance * (1.0 - quoted * (1.0 - lexicon.quoted))
        seen[word] = max(seen.get(word, 0.0), abuse)
    for abuse in seen.values():
        clean *= 1.0 - min(abuse, 0.999)
    return 1.0 - clean


def _digest(text: str) -> Column:
    return F.sha2(F.coalesce(col(text), F.lit("")), 256)


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, y, k) of every distinct labelled text, once for each class it is labelled with; k is a key that has it."""
    known = labels.where(col(label).isin(0, 1)).select(col(key).alias("k"), col(label).cast("int").alias("y")).distinct()
    return documents.select(col(key).alias("k"), _digest(text).alias("digest")).join(known, "k").groupBy("digest", "y").agg(F.min("k").alias("k"))


def sampled(documents: DataFrame, texts: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """(text, y) of at most `most` of the `labelled_texts` of each class: those with the smallest digest, one row each.

    The list of them is bounded, so it is broadcast and all other texts stay where they are read.
    """
    few = texts.where("y = 1").orderBy("digest").limit(most).unionByName(texts.where("y = 0").orderBy("digest").limit(most))
    found = documents.select(col(key).alias("k"), col(text).alias("text"), _digest(text).alias("digest")).join(F.broadcast(few), ["k", "digest"])
    return found.dropDuplicates(["digest", "y"]).select("text", "y")


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """(text, y) of at most `most` distinct labelled texts of each class."""
    return sampled(documents, labelled_texts(documents, labels, label, key, text), key, text, most)


def learn_lexicon(sample: DataFrame, share: float) -> Lexicon:
    """`share`: part of toxic texts among all, to which the sample's classes are weighed back."""

    def count(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                clean: Counter = Counter()
                toxic: dict[str, list[int]] = {}
                for t, y, n in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), batch.column("n").to_pylist(), strict=True):
                    words = {w for w in _WORD.findall((t or "").lower()) if 3 < len(w) <= 40}
                    terms = words | {w[:k] + "*" for w in words for k in PREFIXES if len(w) > k}
                    if y:
                        for term in terms:
                            toxic.setdefault(term, []).append(n)
                    else:
                        clean.update(terms)
                terms = list(clean.keys() | toxic.keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(terms, pa.string()), pa.array([clean[t] for t in terms], pa.int64()), pa.array([toxic.get(t, []) for t in terms], pa.list_(pa.int64()))], names=["term", "clean", "texts"],
                )

    size = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return Lexicon({}, {}, PRIOR["quoted"])
    toxic, clean = col("toxic") / size[1] * share, (col("clean") + 0.5) / size[0] * (1 - share)
    numbered = sample.withColumn("n", F.xxhash64("text"))
    # At most MOST_LABELLED numbers of toxic texts for each term.
    counted = numbered.mapInArrow(count, "term string, clean bigint, texts array<bigint>").groupBy("term").agg(F.sum("clean").alias("clean"), F.flatten(F.collect_list("texts")).alias("texts"))
    best = counted.withColumn("toxic", F.size("texts")).where(col("toxic") >= max(LEAST_DOCUMENTS, LEAST_PART * size[1])).withColumn("chance", toxic / (toxic + clean)).where(col("chance") >= LEAST_CHANCE)

    # All candidates pass by, the most frequent first; only those kept stay, with the numbers of their texts.
    keep: dict[str, float] = {}
    toxic_of: dict[str, int] = {}
    holds: dict[int, list[str]] = {}
    filled: set[str] = set()
    for r in best.orderBy(F.desc("toxic"), F.length("term"), "term").toLocalIterator():
        new = sum(n not in holds for n in r.texts)
        shared = Counter(t for n in r.texts for t in holds.get(n, ()))
        apart = max(shared.values(), default=0) <= MOST_SHARED * r.toxic
        if len(toxic_of) < MOST_TERMS and (apart or new >= max(LEAST_NEW, LEAST_NEW_PART * size[1])):
            keep[r.term], toxic_of[r.term] = r.chance, r.toxic
            for n in r.texts:
                holds.setdefault(n, []).append(r.term)
        if not r.term.endswith("*"):
            # Under a kept beginning, its most frequent whole word stays for the misspellings. It follows its beginnings.
            for start in [s for k in PREFIXES if (s := r.term[:k] + "*") in keep and s not in filled and len(r.term) > k]:
                filled.add(start)
                if r.toxic * 2 >= toxic_of[start]:
                    keep[r.term] = r.chance
    rough = Lexicon(keep, {}, PRIOR["quoted"])

    def measure(batches):
        matcher = Matcher(rough)
        for whole in batches:
            for batch in slices(whole, "text"):
                seen: Counter = Counter()
                for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                    hits = hits_of(t or "", matcher)
                    plain = any(not h.edits and q < 0.5 for _, h, q in hits)
                    if not plain:
                        seen.update({("", 0, y) if not h.edits else (h.term, h.edits, y) for _, h, q in hits})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[i] for k in seen], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32()))] + [pa.array(list(seen.values()), pa.int64())], names=["term", "edits", "y", "n"],
                )

    # At most one row for each term, number of edits and class.
    counted = sample.mapInArrow(measure, "term string, edits int, y int, n bigint").groupBy("term", "edits", "y").agg(F.sum("n").alias("n"))
    found = {(r.term, r.edits, r.y): r.n for r in counted.collect()}

    def chance(term: str, edits: int, prior: float) -> float:
        a, b = found.get((term, edits, 1), 0), found.get((term, edits, 0), 0)
        toxic, clean = a / size[1] * share, b / size[0] * (1 - share)
        return ((toxic / (toxic + clean) if a + b else 0.0) * (a + b) + prior * PRIOR_WEIGHT) / (a + b + PRIOR_WEIGHT)

    return Lexicon(keep, {(t, e): chance(t, e, PRIOR[e]) for t, e, _ in found if e}, chance("", 0, PRIOR["quoted"]))


def score_toxicity(df: DataFrame, lexicon: Lexicon, text: str = "text") -> tuple[DataFrame, str]:
    """`df` with the score of every whole text, and that column's name."""
    (name,) = fresh(df.columns, "score")
    schema = with_fields(df, df.columns, **{name: "double"})

    def score(batches):
        matcher = Matcher(lexicon)
        for whole in batches:
            for batch in slices(whole, text):
                scores = [score_of(t, matcher, lexicon) for t in batch.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return df.mapInArrow(tidy(score), schema), name


def learned(spark: SparkSession, sf_dir: str) -> Lexicon:
    """Lexicon from the labels whose crc32 of the id, modulo 3, is not 1."""
    documents, stages = table(spark, sf_dir, "documents"), Stages(spark, "toxicity")
    known = table(spark, sf_dir, "labels").where(remainder(col("doc_id"), 3) != 1)
    texts = stages(labelled_texts(documents, known, "toxic"), "labelled_texts")
    share = texts.agg(F.avg("y")).first()[0] or 0.0
    return learn_lexicon(stages(sampled(documents, texts), "sample"), share)


@register("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = learned(spark, sf_dir)
    scored, name = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), lexicon)
    return scored.select("doc_id", (remainder(col("doc_id"), 3) == 1).alias("held_out"), name, F.when(col(name) >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
