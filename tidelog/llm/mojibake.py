"""Finding and restoring text garbled by a wrong encoding (problem 9).

The units are words with characters beyond ASCII. A multinomial classifier on hashed byte bigrams,
trained on frequent words of the corpus that are garbled synthetically through every encoding chain,
scores every chain of each distinct word. Multi-byte chains are inverted however they score, single-byte
ones, which turn letters into other letters, unless the classifier calls the word clean by far (SLACK). An
inverse counts only if it decodes strictly and gives a word that the whole corpus has far more often than the garbled one,
or if it is evident: multi-byte sequences that give ordinary characters (see ``evident``), and the
classifier says so. Chains of single-byte encodings have an inverse for nearly every word; which of
these can be words of the corpus is told by sums over their letters, looked up in a bitmap of fixed
size (see ``chains.Letters``), and only those are inverted and compared exactly. The chain of a document
is the classifier's: the likeliest of all its garbled words together among those that explain most.
Words whose inverse is lost (control characters or case dropped after the decoding) are recognised
by doing the same loss to the corpus's words. Replacement characters, stray control characters and
garbled byte order marks need no classifier.

Only distinct words are classified. Counts are over distinct texts, so that copies of a garbled text
bring no votes for it; the classifier alone is fitted on
a bounded number of words (TRAIN_WORDS). Nothing is collected but those words.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import chains
from tidelog.llm.tokenize import strings
from tidelog.session import partitions, ship, written

#: Words the classifier is fitted on: the most frequent ones.
TRAIN_WORDS = 4000
HASH_BITS, SMOOTH = 12, 0.05
#: A word is clean, whatever the corpus has, if a single-byte chain scores so far below clean.
SLACK = 12.0
#: The bitmap of letter sums has 2**SUM_BITS bits; fewer only mean more words to compare.
SUM_BITS = 24
#: An inverse must be so many times as frequent as the word, and at least so frequent.
RATIO, LEAST = 5, 3

#: An evident inverse: so many characters beyond ASCII are bytes, or so far likelier than clean.
EVIDENT, SURE = 4, 12.0
#: How close to the likeliest chain it must score.
CLOSE = 3.0
_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")
_TYPOGRAPHY = frozenset("“”„‘’‚«»‹›…–—•€£¥§©®™°№♪♫´¿¡\xa0、。！？（）［］「」・〜～ー")

_SPLIT = re.compile(r"[ \t\r\n\f\v<>{}]+")
_NON_WORD = re.compile(r"[\W_]+")
_CONTROL = re.compile("[\x80-\x9f]")
ASCII_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalpha())
EDGE = ASCII_EDGE + "…“”„»«’‘–—\xa0¿¡♪、。！？（）［］"


def words(text: str) -> list[str]:
    """The distinct words of ``text`` with characters beyond ASCII, after entities and composition."""
    if text.isascii() and "&" not in text:
        return []
    return list(dict.fromkeys(w for s in _SPLIT.split(normal(text)) if not s.isascii() and (w := s.strip(ASCII_EDGE))))


def normal(text: str) -> str:
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def core(word: str) -> str:
    return word.strip(EDGE).lower()


def terms(word: str) -> list[str]:
    """The word without punctuation at its edges (unless only ASCII is left), and its parts, as they are counted."""
    c = core(word)
    c = word if c.isascii() else c
    return list(dict.fromkeys((c, *(t for t in _NON_WORD.split(c) if not t.isascii()))))


def owned(word: str, chain: tuple[str, str]) -> list[str]:
    """The terms under which ``word`` itself is counted: the whole word where a byte of it is punctuation at its edge."""
    bare = word.strip(EDGE)
    if chain[0] in chains.MULTIBYTE and bare != word and not chains.inverses(bare, chain):
        return [word.lower()]
    return terms(word)


def plausible(text: str) -> bool:
    """Whether the characters beyond ASCII are letters of one common script, usual punctuation or emoji."""
    scripts = set()
    for c in text:
        if c.isalpha():
            scripts.add(unicodedata.name(c, "?").split(" ")[0].split("-")[0])
            if c in "ªº" or "ƀ" <= c <= "ɏ" and c not in "ȘșȚț" or "ɐ" <= c <= "ʯ" or c > "ѿ" and c not in "Ґґ" and not "Ḁ" <= c <= "ỿ" and not "぀" <= c <= "鿿":
                return False
        elif not (c < "\x7f" or c in _TYPOGRAPHY or "☀" <= c <= "➿" or c == "\ufe0f" or "\U0001f000" <= c <= "\U0001faff"):
            return False
    if "CJK" in scripts or "HIRAGANA" in scripts or "KATAKANA" in scripts:
        return bool(scripts & {"HIRAGANA", "KATAKANA"}) and scripts <= {"CJK", "HIRAGANA", "KATAKANA"}
    return not scripts or len(scripts) == 1 and scripts <= set(_SCRIPTS)


def final(inverse: str) -> bool:
    """Whether ``inverse`` is plausible and not garbled once more."""
    return plausible(inverse) and not any((o := chains.ungarble(inverse, ("utf-8", r))) is not None and o != inverse and plausible(o) for r in chains.AGAIN)


def evident(word: str, inverse: str, chain: tuple[str, str], margin: float = 0.0) -> bool:
    """Whether ``word`` is shown garbled by its own bytes, however often it or ``inverse`` occurs.

    That is so if the bytes of its multi-byte sequences give ordinary characters, and either there are
    EVIDENT of them, or the chain is likelier than clean by ``margin`` of SURE, or a sequence
    stands where no spelling has its characters. Repeated garbling counts by its last step.
    """
    changed = sum(c > "\x7f" for c in word)
    if chain[0] not in chains.MULTIBYTE or changed < 2 or inverse.isascii() or not plausible(inverse):
        return False
    if changed >= EVIDENT and margin >= 0:
        return chain[0] == "utf-8" or len(inverse) > 2 and not inverse.isupper()
    return chain[0] == "utf-8" and (margin >= SURE or unspelt(word, inverse, chain))


def unspelt(word: str, inverse: str, chain: tuple[str, str]) -> bool:
    """Whether the characters of a UTF-8 sequence in ``word`` stand as in no spelling.

    A capital after a small letter, a symbol after a letter and before another, a small letter beyond
    ASCII between a capital beyond it and a small letter, a mathematical or box character beside letters.
    """
    if chains.ungarble(word, chain) is None or any(a.islower() and b.isupper() and b > "\x7f" for a, b in zip(inverse, inverse[1:])):
        return False
    for i, c in enumerate(word):
        n = chains.sequence(c, chain[1])
        if not n:
            continue
        before, rest, after = word[i - 1 : i], word[i + 1 : i + n], word[i + n : i + n + 1]
        if c.isupper() and before.islower():
            return True
        if c.isalpha() and after.isalpha() and any(unicodedata.category(r) in ("Sc", "Sk", "Sm", "So", "Po", "No", "Cf") and r not in "…·" for r in rest):
            return True
        if c.isupper() and rest[:1].islower() and after.islower():
            return True
        if unicodedata.category(c) in ("Sm", "So") and (before.isalpha() or after.isalpha()):
            return True
    return False


def marks(text: str) -> int:
    """1 for a replacement character, 2 for a control character, 4 for a garbled byte order mark."""
    return ("�" in text) + 2 * bool(_CONTROL.search(text)) + 4 * text.startswith(chains.MARKS)


def extract(documents: DataFrame, text: str = "text", id_: str = "doc_id") -> DataFrame:
    """(id, words, marks, text_hash) of each document; null and empty texts have none, bytes that are no UTF-8 are replacement characters.

    ``text_hash`` is the same for equal texts, whatever their line ends.
    """
    ship(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in strings(batch.column(1))]
            found = pa.array([words(t) for t in texts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found, pa.array([0 if t.isascii() else marks(t) for t in texts], pa.int32()), batch.column(2)], names=[id_, "words", "marks", "text_hash"])

    hashed = documents.select(id_, text, F.xxhash64(F.regexp_replace(text, "\r", "")).alias("text_hash"))
    return hashed.mapInArrow(run, f"`{id_}` {documents.schema[id_].dataType.simpleString()}, words array<string>, marks int, text_hash long")


def bigrams(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed byte bigrams with a byte beyond ASCII, their item), items framed by spaces."""
    raw = [f" {w} ".encode("utf-8", "replace") for w in items]
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    item = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    keep = (item[1:] == item[:-1]) & ((b[1:] > 127) | (b[:-1] > 127))
    h = ((b[:-1] * np.uint32(256) + b[1:]) * np.uint32(2654435761)) >> np.uint32(32 - HASH_BITS)
    return h[keep].astype(np.int64), item[:-1][keep]


@dataclass(frozen=True)
class Classifier:
    """Log-likelihoods of hashed bigrams per class; the last class is clean text."""

    chains: tuple[tuple[str, str], ...]
    table: np.ndarray

    def scores(self, items: list[str]) -> np.ndarray:
        """(items, classes) log-likelihoods."""
        h, item = bigrams(items)
        out = np.zeros((len(items), len(self.table)), np.float32)
        if len(h):
            starts = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
            out[item[starts]] = np.add.reduceat(self.table.T[h], starts, axis=0)
        out[:, -1] += np.log(len(self.chains))  # clean text is as likely beforehand as all chains together
        return out

    def predict(self, items: list[str]) -> list[tuple[str, str] | None]:
        """The likeliest chain of each item, None for clean."""
        best = self.scores(items).argmax(axis=1)
        return [None if k == len(self.chains) else self.chains[k] for k in best]

    def of_words(self, items: list[str]) -> np.ndarray:
        """Log-likelihoods of the classes for all ``items`` together, as for the words of one document."""
        return self.scores(items).sum(axis=0)


def forms_of(counted: list[tuple[str, int]], chain: tuple[str, str]) -> list[tuple[str, str, int]]:
    """(word, garbled form, count) of the words that the chain changes."""
    return [(w, g, n) for w, n in counted if (g := chains.garble(w, chain)) is not None and g != w]


def weights(items: list[str], counts: list[int]) -> np.ndarray:
    """How often each hashed bigram occurs; a word weighs the root of its count."""
    h, item = bigrams(items) if items else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return np.bincount(h, np.sqrt(np.array(counts, float))[item] if len(h) else None, 1 << HASH_BITS)


def train(counted: list[tuple[str, int]], spark: SparkSession | None = None) -> Classifier:
    """Fit on (word, count) pairs taken as clean, after dropping words that are garbled forms of others or evidently garbled.

    With ``spark`` each chain is garbled and counted by a task; what comes back is a row of fixed size per chain.
    """
    count: dict[str, int] = {}
    for w, n in counted:
        count[core(w)] = count.get(core(w), 0) + n

    def fit(chain: tuple[str, str]) -> tuple[list[str], np.ndarray]:
        forms = forms_of(counted, chain)
        known = [core(g) for w, g, n in forms if len(w) > 1 and 0 < count.get(core(g), 0) * RATIO <= n]
        return known, weights([g for _, g, _ in forms], [n for _, _, n in forms])

    if spark is None:
        fitted = {c: fit(c) for c in chains.CHAINS}
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in batch.column(0).to_pylist():
                    known, table = fit(chains.CHAINS[k])
                    cols = [pa.array([k], pa.int64()), pa.array([known], pa.list_(pa.string())), pa.array([table.astype("<f8").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["chain", "known", "table"])

        each = spark.range(len(chains.CHAINS), numPartitions=min(len(chains.CHAINS), 2 * partitions(spark))).mapInArrow(run, "chain long, known array<string>, table binary")
        fitted = {chains.CHAINS[r.chain]: (r.known, np.frombuffer(r.table, "<f8")) for r in each.collect()}  # a row a chain
    garbled = {w for known, _ in fitted.values() for w in known}
    utf8 = [c for c in chains.CHAINS if c[0] == "utf-8"]
    clean = [(w, n) for w, n in counted if core(w) not in garbled and not any((o := chains.ungarble(w, c)) is not None and evident(w, o, c) for c in utf8)]
    rows = [*(fitted[c][1] for c in chains.CHAINS), weights([w for w, _ in clean], [n for _, n in clean])]
    seen = np.array(rows, float) + SMOOTH
    return Classifier(chains.CHAINS, np.log(seen / seen.sum(axis=1, keepdims=True)).astype(np.float32))


def garbled_words(counts: DataFrame, model: Classifier) -> DataFrame:
    """(word, restored, written, read, strong, changed, sure) of the distinct ``counts`` (word, n) found garbled.

    ``restored`` is null where only a lossy form was recognised. ``strong`` words stand for
    themselves: their characters are the bytes of multi-byte sequences. ``sure`` ones have a chain
    that the classifier finds likelier than clean.
    """
    spark = counts.sparkSession
    table = spark.sparkContext.broadcast(model)  # a fixed number of classes and hash buckets

    def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t, n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for t in dict.fromkeys((*terms(w), w.lower()))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["term", "n"])

    number = {c: k for k, c in enumerate(chains.CHAINS)}

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, rows = batch.column(0).to_pylist(), []
            if not items:
                continue
            scores = table.value.scores(items)
            last = lru_cache(1 << 16)(final)  # chains share many inverses
            held = np.frombuffer(sums.value, np.uint8)
            every = [chains.longer(w) for w in items]
            for i, chain in chains.letters(EDGE).inverses(items, lambda s: held[_slot(s) >> 3] >> (_slot(s) & 7) & 1 > 0):
                every[i].append(chain)
            for w, score, tried in zip(items, scores, every):
                close = score[:-1].max() - CLOSE
                changed = sum(c > "\x7f" for c in w)
                for chain in tried:
                    if chain[0] not in chains.MULTIBYTE and score[number[chain]] < score[-1] - SLACK:
                        continue
                    own = None
                    for o in chains.inverses(w, chain):
                        if chain[0] != "utf-8" and _CONTROL.search(o):
                            continue
                        strong = chain[0] in chains.MULTIBYTE and changed > 1
                        own = own or owned(w, chain)
                        likely = score[number[chain]]
                        if likely >= close and evident(w, o, chain, likely - score[-1]):
                            rows.append((w, own[0], None, o, *chain, True, changed, -number[chain], last(o), bool(likely >= score[-1])))
                        # single-byte encodings turn letters into other letters: there only the whole word is evidence
                        for t in terms(o) if strong else terms(o)[:1]:
                            if t not in own and (len(t) > 1 or chain[0] == "utf-8" and strong):
                                rows.append((w, own[0], t, o, *chain, strong, changed, -number[chain], last(o), bool(likely >= score[-1])))
            cols = list(zip(*rows)) or [[]] * 11
            kinds = [pa.string()] * 6 + [pa.bool_(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["word", "own", "term", "restored", "written", "read", "strong", "changed", "common", "final", "sure"])

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(core(g), core(w), n) for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for g in chains.lossy_forms(w)}
            rows = [(g, n) for g, c, n in rows if g != c and len(g) > 2 and not g.isascii()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["own", "n"])

    counts = counts.repartition(partitions(spark), "word")  # few bytes, but much work per word
    known = written(counts.mapInArrow(count_terms, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), "terms")
    sums = spark.sparkContext.broadcast(_bitmap(known.where(F.col("n") >= LEAST)))  # 2**SUM_BITS bits
    tries = counts.select("word").mapInArrow(invert, "word string, own string, term string, restored string, written string, read string, strong boolean, changed int, common int, final boolean, sure boolean")
    lost = counts.where(F.col("n") >= LEAST).mapInArrow(lose, "own string, n long").groupBy("own").agg(F.max("n").alias("of"))
    far = F.col("of") >= F.greatest(F.lit(LEAST), RATIO * F.coalesce("mine", F.lit(0)))
    mine = known.select(F.col("term").alias("own"), F.col("n").alias("mine"))
    # sizes of what Python produces are guessed low: merge joins, so that none of it is broadcast
    tries = written(tries, "tries")
    voted = tries.join(known.select("term", F.col("n").alias("of")).hint("merge"), "term").join(mine.hint("merge"), "own", "left").where(far)
    alone = tries.where("term is null").withColumn("of", F.lit(0))  # evident ones need no votes; votes still choose between inverses
    picked = ("word", "restored", "written", "read", "strong", "changed", "common", "final", "sure", "of")
    inverted = voted.select(*picked).unionByName(alone.select(*picked))
    best = inverted.groupBy("word").agg(F.max_by(F.struct("restored", "written", "read", "strong", "changed", "sure"), F.struct("strong", "final", "of", "restored", "common")).alias("b"))  # of equal results the commoner encoding
    keyed = counts.select("word").mapInArrow(_cores, "word string, own string")
    lossy = keyed.join(lost.hint("merge"), "own").join(mine.hint("merge"), "own", "left").where(far).select("word", F.lit(True).alias("lossy")).distinct()
    both = best.join(lossy.hint("merge"), "word", "full_outer")
    return both.select("word", "b.restored", "b.written", "b.read", (F.coalesce("b.strong", F.lit(False)) | F.coalesce("lossy", F.lit(False))).alias("strong"), F.coalesce("b.changed", F.lit(1)).alias("changed"), F.coalesce("b.sure", F.lit(False)).alias("sure"))


def _slot(sums: np.ndarray) -> np.ndarray:
    return (sums >> np.uint64(64 - SUM_BITS)).astype(np.int64)


def _bitmap(known: DataFrame) -> bytes:
    """One bit for the letter sum of each term of ``known``; collected as 2**(SUM_BITS - 15) rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.array([chains.letters(EDGE).of(t) for t in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_slot(sums))], names=["slot"])

    slots = known.select("term").mapInArrow(run, "slot long").groupBy(F.shiftright("slot", 15).alias("block"))
    out = bytearray(1 << (SUM_BITS - 3))
    for row in slots.agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND((1 << 15) - 1)).alias("bits")).collect():
        out[row.block << 12 : row.block + 1 << 12] = row.bits
    return bytes(out)


def _cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([terms(w)[0] for w in batch.column(0).to_pylist()], pa.string())], names=["word", "own"])


@dataclass(frozen=True)
class Garbled:
    """``documents`` (doc_id, marks, words: array of word, restored, written, read, strong); found ones only."""

    documents: DataFrame
    words: DataFrame
    model: Classifier


def find(documents: DataFrame, train_words: int = TRAIN_WORDS) -> Garbled:
    """The garbled documents of the table.

    A document is found if it has a mark, a strong garbled word, or legacy-encoded evidence: a
    garbled word whose chain is likelier than clean, two different ones or one with three changed characters. Null, empty and ASCII texts are never
    found. Ids should be unique; rows that share one are judged together.
    """
    parts = written(extract(documents), "words")
    each = parts.select("doc_id", F.explode("words").alias("word"))
    once = parts.where(F.size("words") > 0).groupBy("text_hash").agg(F.first("words").alias("words"))
    counts = written(once.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")), "counts")
    frequent = written(counts.orderBy(F.desc("n"), "word").limit(train_words), "frequent")  # ranked by executors, not the driver
    model = train([(r.word, r.n) for r in frequent.orderBy(F.desc("n"), "word").collect()], documents.sparkSession)
    bad = written(garbled_words(counts, model), "garbled")
    held = each.join(bad, "word").groupBy("doc_id").agg(
        F.max("strong").alias("strong"), F.countDistinct("word").alias("different"), F.max("changed").alias("changed"), F.max("sure").alias("sure"), F.collect_set(F.struct("word", "restored", "written", "read", "strong")).alias("words")
    )
    marked = parts.where("marks > 0").select("doc_id", "marks").groupBy("doc_id").agg(F.bit_or("marks").alias("marks"))
    enough = F.col("strong") | F.col("sure") | (F.col("different") >= 2) | (F.col("changed") >= 3)
    found = held.where(enough).join(marked, "doc_id", "full_outer").select("doc_id", F.coalesce("marks", F.lit(0)).alias("marks"), "words")
    return Garbled(found, bad, model)


def restore(documents: DataFrame, garbled: Garbled) -> DataFrame:
    """(doc_id, restored, written, read, complete) of the found documents.

    ``written`` and ``read`` name the chain of the document: of those that explain most of its garbled
    words, the one its words are likeliest under. Only garbled words are changed, and whole lines of
    them; all else stays as it is, to the byte. ``complete`` says that nothing known to be garbled was left.
    """
    spark = ship(documents.sparkSession)
    table = spark.sparkContext.broadcast(garbled.model)  # a fixed number of classes and hash buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, found in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist()):
                found = found or []
                swap = {w["word"]: w["restored"] for w in found if w["restored"] is not None}
                tried = {(w["written"], w["read"]) for w in found if w["restored"] is not None}
                out, chain = restored(text or "", swap, tried, table.value)
                rows.append((doc, out, *chain, len(swap) == len(found) and not marks(out)))
            kinds = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["doc_id", "restored", "written", "read", "complete"])

    joined = documents.select("doc_id", "text").join(garbled.documents.select("doc_id", "words"), "doc_id")
    return joined.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, restored string, written string, read string, complete boolean")


def chain_of(swap: dict[str, str], tried: set[tuple[str, str]], model: Classifier) -> tuple[tuple[str, str], int]:
    """(chain, how often it was gone through) of the garbled words ``swap``."""
    likely = model.of_words(sorted(swap))
    options = []
    for c in tried:
        for depth in range(1, chains.DEPTH + 1 if c[0] == "utf-8" else 2):
            explained = sum((o := chains.unwound(w, c, depth)) is not None and unicodedata.normalize("NFC", o) == own for w, own in swap.items())
            options.append((explained, -depth, float(likely[chains.CHAINS.index(c)]), c))
    _, less, _, chain = max(options)
    return chain, -less


def restored(text: str, swap: dict[str, str], tried: set[tuple[str, str]], model: Classifier) -> tuple[str, tuple[str | None, str | None]]:
    """(the text with its garbled words and lines inverted, its chain); what is not garbled stays as it is."""
    mark = next((m for m in chains.MARKS_UTF8 if text.startswith(m)), "")
    text = "\ufeff" * bool(mark) + text[len(mark) :]
    if not swap:
        return text, (None, None)
    chain, depth = chain_of(swap, tried, model)
    others = [w for w in words(text) if w not in swap]
    scores = model.scores([*others, *swap])
    margin = scores[:, chains.CHAINS.index(chain)] - scores[:, -1]
    most = len(swap) > len(others) or float(margin.sum()) > 0
    # words without a counterpart in the corpus: all of them if the text as a whole is likelier garbled than clean, else those likelier so beside garbled ones
    likely = {w for w, m in zip(others, margin.tolist()) if most or m >= 0}
    composed = lambda s: None if s is None else unicodedata.normalize("NFC", s)

    def line(s: str) -> str:
        if s.isascii() and "&" not in s:
            return s
        beyond = words(s)
        sure = [w for w in beyond if w in swap]
        if not (sure or most):
            return s
        if not s.isascii() and (chain[0] in chains.MULTIBYTE or all(w in swap or w in likely for w in beyond)):
            o = chains.unwound(s, chain, depth)
            if o is not None and (most and "&" not in s or all(swap[w] in composed(o) for w in sure)):
                return o
        return "".join(p if p.isascii() and "&" not in p else piece(p) for p in re.split(f"({_SPLIT.pattern})", s))

    def piece(p: str) -> str:
        for w in words(p):
            if w not in swap and w not in likely:
                continue
            o = chains.unwound(w, chain, depth)
            o = o if w not in swap or composed(o) == swap[w] or most and o is not None else swap[w]
            if o is not None and (span := _span(p, w)):
                p = p[: span[0]] + o + p[span[1] :]
        return p

    return "\n".join(line(s) for s in text.split("\n")), chain


def _span(p: str, word: str) -> tuple[int, int] | None:
    """Where in ``p`` the word stands, as it is or written with entities or uncomposed."""
    if (at := p.find(word)) >= 0:
        return at, at + len(word)
    if normal(p) == p:
        return None
    spans = ((i, i + n) for n in range(len(word), len(p) + 1) for i in range(len(p) - n + 1))
    found = next(((i, j) for i, j in spans if normal(p[i:j]) == word), None)
    if found and normal(p[found[0] : found[1] + 1]) == word:  # an entity may end without its semicolon
        return found[0], found[1] + 1
    return found


#: Kinds of synthetic garbling, and the share of the clean documents that are garbled for a measurement.
KINDS, EVERY = ("whole", "line", "word"), 8


def garble_some(documents: DataFrame, seed: int = 0, every: int = EVERY) -> DataFrame:
    """(doc_id, text, clean, kind, written, read): one in ``every`` documents, chosen by hash, garbled by a chain chosen by hash.

    Whole, in its longest line beyond ASCII, or in one word. Those that no chain can change keep a null ``kind``.
    """
    ship(documents.sparkSession)

    def part(text: str, kind: str, pick: int) -> tuple[int, int] | None:
        """The span to garble: the text, a line or a word."""
        if kind == "whole":
            return 0, len(text)
        spans = [m.span() for m in re.finditer(r"[^\r\n]+" if kind == "line" else r"[^\s<>{}]+", text) if not m.group().isascii()]
        return max(spans, key=lambda s: s[1] - s[0]) if kind == "line" and spans else spans[pick % len(spans)] if spans else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, h in zip(batch.column(0).to_pylist(), strings(batch.column(1)), batch.column(2).to_pylist()):
                row = (doc, text, None, None, None, None)
                pick = h // every
                span = part(text, KINDS[pick % 3], pick) if text and h % every == 0 and not text.isascii() else None
                for k in range(len(chains.CHAINS)) if span else ():
                    chain = chains.CHAINS[(pick // 3 + k * 97) % len(chains.CHAINS)]
                    g = chains.garble(text[span[0] : span[1]], chain)
                    if g is not None and g != text[span[0] : span[1]]:
                        row = (doc, text[: span[0]] + g + text[span[1] :], text, KINDS[pick % 3], *chain)
                        break
                rows.append(row)
            kinds = [batch.schema.field(0).type, *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=["doc_id", "text", "clean", "kind", "written", "read"])

    hashed = documents.select("doc_id", "text", F.abs(F.xxhash64("doc_id", F.lit(seed)) % (1 << 40)).alias("h"))
    return hashed.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, text string, clean string, kind string, written string, read string")


def accuracy(documents: DataFrame, seed: int = 0) -> DataFrame:
    """(kind, encoding, documents, found, chain_right, restored) of synthetically garbled documents held out of the fit.

    The documents not found garbled are taken as clean, one in EVERY of them is garbled, and the whole is searched
    again, with a classifier fitted anew. ``chain_right`` counts the documents whose one predicted chain turns the garbled
    part back exactly (chains that give the same text are one), ``restored`` those that come back exactly as they were.
    ``encoding`` is that of the original: utf-8, double byte or single byte.
    """
    clean = documents.join(find(documents).documents.select("doc_id"), "doc_id", "left_anti")
    mixed = written(garble_some(clean, seed), "mixed")
    found = find(mixed)
    back = restore(mixed, found).select("doc_id", "restored", F.col("written").alias("said"), F.col("read").alias("said_read"))
    true = mixed.where("kind is not null").join(back, "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            rows = []
            for text, orig, kind, enc, restored_, said, said_read in zip(*cols):
                right = False
                if said is not None:
                    pairs = [(a, b) for a, b in zip(text.split("\n"), orig.split("\n")) if a != b] if text.count("\n") == orig.count("\n") else [(text, orig)]
                    if kind == "word":
                        pairs = [(x, y) for a, b in pairs for x, y in zip(a.split(" "), b.split(" ")) if x != y]
                    right = all(any(chains.unwound(a, (said, said_read), n) == b for n in range(1, chains.DEPTH + 1)) for a, b in pairs)
                rows.append((kind, "utf-8" if enc == "utf-8" else "double byte" if enc in chains.MULTIBYTE else "single byte", restored_ is not None, right, restored_ == orig))
            kinds = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["kind", "encoding", "found", "right", "same"])

    each = true.select("text", "clean", "kind", "written", "restored", "said", "said_read").mapInArrow(run, "kind string, encoding string, found boolean, right boolean, same boolean")
    count = lambda c: F.sum(F.col(c).cast("long"))
    return each.groupBy("kind", "encoding").agg(F.count(F.lit(1)).alias("documents"), count("found").alias("found"), count("right").alias("chain_right"), count("same").alias("restored"))
