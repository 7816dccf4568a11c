"""Subject areas of documents, by a seeded non-negative factorisation of the document-term matrix.

V (documents x terms, prose only) is factored into W (documents x components) and H (components x terms) by alternating
multiplicative updates under the Kullback-Leibler divergence. One component is anchored to each subject: it starts from
the terms that labelled documents and the subject's description favour; free components take up what belongs to no
subject. The documents are encoded once (term numbers and counts) and written to the shared folder. In every round the
workers solve W for their documents with H fixed and add up their share of the next H, so documents never leave their
partition and the driver holds nothing but H, whose size ``MAX_TERMS`` bounds.

The result is read from W, solved once more with the final H: a document's mixture is its components' share of its terms,
and a term of the document belongs to a component by its posterior in that mixture, w h / sum(w h). Subjects with enough
of a document's terms (``LEAST_MASS``) are its candidates; such a subject counts if three of the document's sentences deal
with it, each through two different terms that belong to it.

Defined results
* null, blank and code-only texts have no subject; rows whose doc_id is null are left out; repeated rows count once.
* a label outside ``subjects``, in any spelling of case and blanks, is ignored; of annotators who disagree each counts
  with its share of the document's labels.
* with no usable labels the descriptions alone seed; with no subjects there are no rows.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Components without a subject; rounds; inner updates of W a round; terms must occur in so many documents and such a share.
FREE, ROUNDS, INNER = 8, 12, 8
MIN_DF, MIN_DF_SHARE = 3, 1e-5
#: Terms of a language at most, the most frequent first: H has so many columns a language, 4 bytes a component in each.
MAX_TERMS = 200_000
#: At most so many labelled documents seed the factorisation (drawn by hash); everything else covers all documents.
MAX_LABELLED = 100_000
#: A term of a document belongs to a subject from this posterior on; terms that a sentence needs, sentences that a document needs.
TERM_SHARE, TERMS_IN_SENTENCE, SENTENCES = 0.3, 2, 3
#: Terms of a document (repeats damped) that its mixture must give a subject.
LEAST_MASS = 1.5

_TERM = re.compile(r"[^\W\d_]{3,}")
_COMMENT = re.compile(r"^[ \t]*(?://[/!]?|/\*+|\*+/?|\#+(?=\s)|--(?=\s)|;+(?=\s)|<!--|>+|[-*+•](?=\s))[ \t]?")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)")
_CODE = re.compile(
    r"[;{}]\s*$|^\s*[})\]]|^\s*(?:def|class|func|fn|function|let|const|var|import|from|return|if|for|while|else|elif|try|raise|throw|public|private|static|pub|use|package|self|log|console|assert|with|switch|case)\b.*(?:[(){}\[\]=:;]|\w\.\w)|^\s*[\w.\[\]]+(?:, [\w.]+)*\s*(?::?=|[-+*/|&%]=|<-)\s*\S|^\s*[\w.:]+!?\([^)]*\)?.*\)?;?\s*$|^\s*@\w+|^\s*\#\[|^\s{4,}[\w.]+\("
)
_SENTENCE = re.compile(r"[^.!?]+(?:[.!?](?![\s\"')\]]|$)[^.!?]*)*[.!?]+")


def sentences(text: str | None) -> list[str]:
    """The sentences of a text's prose: code lines out, comment marks off, wrapped lines joined, unfinished ones dropped."""
    if not text:
        return []
    paragraphs: list[list[str]] = [[]]
    fenced = False
    for line in text.replace("\r", "").split("\n"):
        if _FENCE.match(line):
            fenced = not fenced
            paragraphs.append([])
            continue
        m = _COMMENT.match(line)
        body = line[m.end() :] if m else line
        s = body.strip()
        if fenced or not s or (not m and _CODE.search(line)) or (m and _CODE.search(s) and not s.endswith((".", "!", "?"))):
            paragraphs.append([])
            continue
        if m and m[0].strip()[:1] in "-+•>" or line[:1] == "#" and not m:
            paragraphs.append([])
        if m and m[0].strip() == "*" and not text.lstrip().startswith("/*"):
            pass
        paragraphs[-1].append(s)
    out: list[str] = []
    for p in paragraphs:
        if p:
            out += _SENTENCE.findall(" ".join(p))
    return out


def terms(sentence: str) -> list[str]:
    return _TERM.findall(sentence.lower())


#: Function words that tell languages apart.
FUNCTION_WORDS = {
    "en": "the and of to is are with for that this it was one from has not be by when in on its".split(),
    "de": "der die das und ist nicht mit von zu für wird den dem ein eine einer auf bei nach vor zum zur ohne wenn keine es".split(),
    "es": "el la los las de que y en se un una por con para del al no es sin si lo su como".split(),
    "fr": "le la les des et est une dans pour que du au aux sur pas ce cette avec sans si il ne se".split(),
    "pt": "o a os as de que e em se um uma por com para do da no na não é sem".split(),
    "it": "il lo la gli le di che e in si un una per con del della non è senza".split(),
    "nl": "de het een en van is niet met voor op te dat die zijn bij naar zonder als".split(),
}
_LANGUAGE_OF: dict[str, list[str]] = defaultdict(list)
for _lang, _list in FUNCTION_WORDS.items():
    for _w in _list:
        _LANGUAGE_OF[_w].append(_lang)
_ANY_WORD = re.compile(r"[^\W\d_]+")


def _language_votes(sentence: str) -> Counter:
    votes: Counter = Counter()
    for w in _ANY_WORD.findall(sentence.lower()):
        for lang in _LANGUAGE_OF.get(w, ()):
            votes[lang] += 1.0 / len(_LANGUAGE_OF[w])
    return votes


def by_language(sents: list[str]) -> list[str]:
    """Each sentence as ``language|its distinct terms``. A sentence without a clear language has its document's."""
    votes = [_language_votes(s) for s in sents]
    whole = sum(votes, Counter())
    usual = max(whole, key=lambda k: (whole[k], k)) if whole else "en"
    out = []
    for s, v in zip(sents, votes):
        top = v.most_common(2)
        clear = top and top[0][1] >= 1.5 and (len(top) == 1 or top[0][1] >= 2 * top[1][1])
        out.append((top[0][0] if clear else usual) + "|" + " ".join(dict.fromkeys(terms(s))))
    return out


# --- factorisation, pure numpy -----------------------------------------------------------------------------------


def solve_w(starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, h: np.ndarray, inner: int = INNER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """W for documents given H (terms x components), whose entries begin at ``starts`` (each has one at least); the entries'
    numbers of documents; and their parts w h, which divided by their sums are the posteriors of the components."""
    size = np.diff(np.append(starts, len(cols)))
    rows = np.repeat(np.arange(len(starts)), size)
    w = np.full((len(starts), h.shape[1]), 1.0 / h.shape[1], h.dtype)
    hc = h[cols]
    total = np.maximum(np.add.reduceat(vals, starts), 1e-12)[:, None]
    for _ in range(inner):
        ratio = vals / np.maximum(np.einsum("ij,ij->i", w[rows], hc), 1e-30)
        w *= np.add.reduceat(ratio[:, None] * hc, starts, axis=0) / total
    return w, rows, w[rows] * hc


def h_share(starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What these documents add to the next H (before it is scaled): terms, and a row of components for each."""
    _, _, part = solve_w(starts, cols, vals, h)
    part *= (vals / np.maximum(part.sum(1), 1e-30))[:, None]
    order = np.argsort(cols, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(cols[order]) > 0])
    return cols[order][first], np.add.reduceat(part[order].astype(np.float64), first, axis=0)


def seed_h(df: np.ndarray, n_docs: float, by_subject: np.ndarray, labelled: np.ndarray, described: np.ndarray, free: int = FREE) -> np.ndarray:
    """The first H. What is zero in it stays zero, for the updates only multiply; that is what anchors the components.

    df: documents a term; by_subject: labelled documents a subject and term; labelled: such documents a subject;
    described: subject x term, 1 where the description has the term. A term's lift in a subject is its rate among the
    subject's labelled documents against its rate in all, shrunk by one document.

    * a term with clear evidence (two labelled documents or more, twice the lift it has in the third best subject) is
      anchored: only the subjects with half the best lift or more have it, and no free component;
    * a term that the labels had every chance to tie to a subject, and did not, is in free components only;
    * every other term starts in all of them, in a subject by its lift or its description's word for it.
    """
    share = df / max(n_docs, 1)
    expect = labelled[:, None] * share[None, :]
    lift = (by_subject + 1.0) / (expect + 1.0)
    ranked = np.sort(lift, 0)[::-1]
    best = ranked[0]
    third = ranked[2] if len(ranked) > 2 else np.ones_like(best)
    anchored = (best >= 2.0) & (best >= 2.0 * third) & (by_subject.max(0) >= 2.0)
    general = ~anchored & (best < 1.6) & (expect.max(0) >= 3.0)
    near = lift >= 0.5 * best
    sub = share[None, :] * np.where(near & (lift >= 1.5), lift**4, 0.01) + share[None, :] * 50.0 * described
    sub = np.where(anchored[None, :], near * sub, np.where(general[None, :], 0.0, sub))
    rng = np.random.default_rng(7)
    common = np.tile(share, (free, 1)) * rng.uniform(0.5, 1.5, (free, len(share)))
    common[:, anchored] = 0.0
    h = np.vstack([sub, common])
    return h / np.maximum(h.sum(1, keepdims=True), 1e-300)


# --- DataFrame operators -----------------------------------------------------------------------------------------


def _prose_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"doc_id": b["doc_id"], "sentences": [by_language(sentences(t)) for t in b["text"]]})


def prose(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, sentences): each sentence as its language and distinct terms. Written once to the shared folder, read in every round."""
    d = documents.where(F.col(doc_id).isNotNull() & (F.length(F.trim(text)) > 0)).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut(d.mapInPandas(_prose_batches, "doc_id long, sentences array<string>").dropDuplicates(["doc_id", "sentences"]))


def clean_labels(labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, weight): a subject's share of a document's labels, each annotator once."""
    s = labels.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.lower(F.trim("subject")).alias("subject"), "annotator").where(F.col("subject").isin(subjects)).distinct()
    c = s.groupBy("doc_id", "subject").count()
    t = c.groupBy("doc_id").agg(F.sum("count").alias("n"))
    return c.join(t, "doc_id").select("doc_id", "subject", (F.col("count") / F.col("n")).alias("weight"))


class Vocabulary:
    """The numbers of each language's terms, the languages one after the other."""

    def __init__(self, words: dict[str, list[str]]) -> None:
        self.words = words
        self.look: dict[str, dict[str, int]] = {}
        self.span: dict[str, tuple[int, int]] = {}
        at = 0
        for lang, ws in words.items():
            self.look[lang] = {w: at + i for i, w in enumerate(ws)}
            self.span[lang] = at, at + len(ws)
            at += len(ws)
        self.size = at

    def encode(self, docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, sentence, term) of every known term of a batch of documents. A document's part in one language is a row of
        the matrix: row = document * languages + language."""
        rows: list[int] = []
        sents: list[int] = []
        cols: list[int] = []
        number = {lang: i for i, lang in enumerate(self.look)}
        for i, ss in enumerate(docs):
            for j, s in enumerate(ss):
                lang, _, text = s.partition("|")
                look = self.look.get(lang)
                if look:
                    c = [x for x in map(look.get, text.split(" ")) if x is not None]
                    cols += c
                    rows += [i * len(number) + number[lang]] * len(c)
                    sents += [j] * len(c)
        return np.array(rows, np.int64), np.array(sents, np.int64), np.array(cols, np.int64)

    def matrix(self, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (row, term) of what ``encode`` gives: rows, their starts, terms, sentences that hold each, and for
        every incidence its entry."""
        code, back, count = np.unique(rows * max(1, self.size) + cols, return_inverse=True, return_counts=True)
        r, c = code // max(1, self.size), code % max(1, self.size)
        starts = np.flatnonzero(np.r_[True, np.diff(r) > 0]) if len(r) else np.empty(0, int)
        return r[starts], starts, c, count, back


class Model:
    """The vocabulary and the final H, terms x components, in single precision."""

    def __init__(self, subjects: list[str], vocabulary: Vocabulary, h: np.ndarray) -> None:
        self.subjects, self.vocabulary, self.h = subjects, vocabulary, h


def _bag(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, term), each once."""
    s = docs.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", F.substring_index("s", "|", 1).alias("lang"), F.explode(F.split(F.substring_index("s", "|", -1), " ")).alias("term"))
    return s.where("term <> ''").groupBy("doc_id", "lang").agg(F.collect_set("term").alias("terms")).select("doc_id", "lang", F.explode("terms").alias("term"))


def fit(docs: DataFrame, subjects: DataFrame, labels: DataFrame, rounds: int = ROUNDS, free: int = FREE) -> Model:
    """The factorisation over all documents of ``prose``, for each language its own block of the matrix."""
    spark = docs.sparkSession
    named = [(r[0], r[1]) for r in subjects.select(F.lower(F.trim("subject")), F.coalesce("description", F.lit(""))).where("subject is not null").distinct().orderBy("subject").collect()]
    names = list(dict.fromkeys(s for s, _ in named))
    at = {s: i for i, s in enumerate(names)}
    rows = docs.select("doc_id", F.explode("sentences").alias("s")).select("doc_id", F.substring_index("s", "|", 1).alias("lang"))
    n_docs = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count_distinct("doc_id")).collect()}
    bag = cut(_bag(docs).groupBy("lang", "term").count())
    words: dict[str, list[str]] = {}
    counts: dict[str, list[float]] = {}
    for lang in sorted(n_docs):  # the least frequency is a share of the language's own documents
        least = max(MIN_DF, int(np.ceil(MIN_DF_SHARE * n_docs[lang])))
        known = bag.where((F.col("lang") == lang) & (F.col("count") >= least)).orderBy(F.desc("count"), "term").limit(MAX_TERMS)
        got = sorted((r["term"], float(r["count"])) for r in known.toLocalIterator())
        if got:
            words[lang], counts[lang] = [t for t, _ in got], [c for _, c in got]
    vocabulary = Vocabulary(words)
    if not words or not names:
        return Model([], vocabulary, np.zeros((0, 0), np.float32))
    look = {lang: {w: i for i, w in enumerate(ws)} for lang, ws in words.items()}
    lab = clean_labels(labels, names)
    keep = lab.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    few = docs.join(lab.join(keep, "doc_id", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi")
    ls = _bag(few).join(lab, "doc_id")
    by = {lang: np.zeros((len(names), len(ws))) for lang, ws in words.items()}
    for r in ls.groupBy("lang", "subject", "term").agg(F.sum("weight").alias("w")).toLocalIterator():
        j = look.get(r["lang"], {}).get(r["term"])
        if j is not None:
            by[r["lang"]][at[r["subject"]], j] = r["w"]
    totals = {(r["lang"], r["subject"]): r["n"] for r in ls.select("doc_id", "lang", "subject", "weight").distinct().groupBy("lang", "subject").agg(F.sum("weight").alias("n")).collect()}
    h: dict[str, np.ndarray] = {}
    for lang, ws in words.items():
        described = np.zeros((len(names), len(ws)))
        for s, text in named:
            for w in terms(s + " " + text):
                if w in look[lang] and w not in _LANGUAGE_OF:
                    described[at[s], look[lang][w]] = 1.0
        h[lang] = seed_h(np.array(counts[lang]), n_docs[lang], by[lang], np.array([totals.get((lang, s), 0.0) for s in names]), described, free)
    anchors = {lang: x[: len(names)].copy() for lang, x in h.items()}
    # a subject that nothing seeds in a language has no component there
    seeded = {lang: np.array([totals.get((lang, s), 0.0) > 0 or bool(d) for s, d in zip(names, _described(names, named, look[lang]))]) for lang in words}
    for lang in h:
        h[lang][: len(names)][~seeded[lang]] = 0.0
    index = spark.sparkContext.broadcast(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = index.value
        for b in batches:
            r, _, c = v.encode(b["sentences"])
            _, starts, c, n, _ = v.matrix(r, c)
            if not len(starts):
                continue
            ends = np.append(starts[1:], len(c))
            yield pd.DataFrame({"cols": [c[s:e].astype(np.int32) for s, e in zip(starts, ends)], "n": [n[s:e].astype(np.int32) for s, e in zip(starts, ends)]})

    coded = cut(docs.mapInPandas(encode, "cols array<int>, n array<int>"))
    k = len(names) + free
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(_stack(h, vocabulary))

        def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hh = now.value
            total = np.zeros(hh.shape)
            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    part = b.slice(lo, 2048)
                    at = part.column("cols").offsets.to_numpy().astype(np.int64)
                    cols, n = part.column("cols").flatten().to_numpy(), part.column("n").flatten().to_numpy()
                    if len(cols):
                        t, x = h_share(at[:-1] - at[0], cols, np.sqrt(n).astype(np.float32), hh)
                        total[t] += x
            used = np.flatnonzero(total.any(1))
            if len(used):
                yield pa.record_batch([pa.array(used.astype(np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total[used].ravel()), hh.shape[1]).cast(pa.list_(pa.float64()))], ["term", "parts"])

        got = coded.mapInArrow(share, "term int, parts array<double>").groupBy("term").agg(F.array(*(F.sum(F.col("parts")[i]) for i in range(k))).alias("p"))
        new = np.zeros((vocabulary.size, k))
        for r in got.toLocalIterator():
            new[r["term"]] = r["p"]
        for lang in h:
            a, b = vocabulary.span[lang]
            h[lang], _ = rescale(new[a:b].T, anchors[lang], seeded[lang])
        now.unpersist()
    return Model(names, vocabulary, _stack(h, vocabulary))


def _stack(h: dict[str, np.ndarray], v: Vocabulary) -> np.ndarray:
    """All languages' H, terms x components."""
    return np.concatenate([h[lang].T for lang in v.words]).astype(np.float32)


def _described(names: list[str], named: list[tuple[str, str]], look: dict[str, int]) -> list[bool]:
    text = defaultdict(str)
    for s, d in named:
        text[s] += " " + s + " " + d
    return [any(w in look and w not in _LANGUAGE_OF for w in terms(text[s])) for s in names]


def rescale(new: np.ndarray, anchor: np.ndarray, seeded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The next H with rows that sum to 1, a tenth of each anchored row kept at its seed; and the components' mass."""
    weight = new.sum(1)
    h = new / np.maximum(weight[:, None], 1e-300)
    n = len(anchor)
    h[:n] = 0.9 * h[:n] + 0.1 * anchor
    h[:n][~seeded] = 0.0
    weight[:n][~seeded] = 0.0
    return h, weight


def mixtures(docs, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of documents: each subject's share of the document's terms, its mass in terms (repeats damped), and the
    sentences that deal with it. All three documents x subjects, from W and the final H."""
    k, v = len(model.subjects), model.vocabulary
    share, mass, count = np.zeros((len(docs), k)), np.zeros((len(docs), k)), np.zeros((len(docs), k), np.int64)
    rows, sents, cols = v.encode(docs)
    if not len(rows) or not k:
        return share, mass, count
    r, starts, c, n, back = v.matrix(rows, cols)
    vals = np.sqrt(n).astype(np.float32)
    _, of, part = solve_w(starts, c, vals, model.h)
    post = part / np.maximum(part.sum(1, keepdims=True), 1e-30)
    doc = r[of] // len(v.look)
    for i in range(k):
        mass[:, i] = np.bincount(doc, post[:, i] * vals, len(docs))
    share = mass / np.maximum(np.bincount(doc, vals, len(docs)), 1e-12)[:, None]
    speaks = post[:, :k] >= TERM_SHARE
    # different terms of each sentence that belong to each subject
    sentence = rows // len(v.look) * (sents.max() + 1) + sents
    _, number = np.unique(sentence, return_inverse=True)
    m = number.max() + 1
    held = np.zeros((m, k), np.int64)
    for i in range(k):
        held[:, i] = np.bincount(number, speaks[back, i], m)
    # a term that belongs to two subjects makes no sentence of the lesser one
    deals = (held >= TERMS_IN_SENTENCE) & (held == held.max(1, keepdims=True))
    whose = np.zeros(m, np.int64)
    whose[number] = rows // len(v.look)
    np.add.at(count, whose, deals)
    return share, mass, count


def document_subjects(documents: DataFrame, subjects: DataFrame, labels: DataFrame, least: int = SENTENCES) -> DataFrame:
    """(doc_id, subject, share, n_sentences): the subjects of every document, spelled as in ``subjects``; ``share`` is what
    the document's mixture gives the subject."""
    docs = prose(documents)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, subjects, labels))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            share, mass, count = mixtures(b["sentences"], m)
            i, k = np.nonzero((mass >= LEAST_MASS) & (count >= least))
            if len(i):
                yield pd.DataFrame({"doc_id": b["doc_id"].to_numpy()[i], "key": [m.subjects[x] for x in k], "share": np.round(share[i, k], 4), "n_sentences": count[i, k].astype(np.int32)})

    got = docs.mapInPandas(assign, "doc_id long, key string, share double, n_sentences int").groupBy("doc_id", "key").agg(F.max(F.struct("n_sentences", "share")).alias("m"))
    spelled = subjects.where("subject is not null").groupBy(F.lower(F.trim("subject")).alias("key")).agg(F.min("subject").alias("subject"))
    return got.join(spelled, "key").select("doc_id", "subject", "m.share", "m.n_sentences")


def composition(found: DataFrame) -> DataFrame:
    """(subject, n_documents, n_sentences, weight): the corpus by subject; ``weight`` is the sum of the mixtures' shares."""
    return found.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"), F.round(F.sum("share"), 2).alias("weight"))
