"""Evaluation texts leaking into training text: a suffix automaton of the test items over streamed words."""

from __future__ import annotations

import itertools
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom import scratch
from runloom.llm.mail import readable_texts, word_places, words

MIN_WORDS = 12
#: Words of test items in one automaton; more items are matched in blocks, each over all documents.
BLOCK_WORDS = 400_000


class Automaton:
    """Generalised suffix automaton of word sequences. A state is a set of word strings with one set of end places;
    `items` lists, for states that hold strings of at least `least` words, the items that contain them."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least = least
        self.vocabulary: dict[str, int] = {}
        self.to: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        for item, text in items:
            last = 0
            for w in text:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)), ends)
                ends[last].add(item)
        # what ends in a state ends in its suffix link too; longer states first
        for s in sorted(range(1, len(self.to)), key=lambda s: -self.length[s]):
            if self.length[s] >= least and self.link[s] > 0:
                ends[self.link[s]] |= ends[s]
        self.items = [tuple(sorted(e)) if n >= least else () for e, n in zip(ends, self.length)]

    def _clone(self, state: int, length: int, ends: list[set[int]]) -> int:
        self.to.append(dict(self.to[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        ends.append(set())
        return len(self.to) - 1

    def _extend(self, last: int, w: int, ends: list[set[int]]) -> int:
        if (q := self.to[last].get(w)) is not None:
            if self.length[q] == self.length[last] + 1:
                return q
            c = self._clone(q, self.length[last] + 1, ends)
            self.link[q] = c
            while last >= 0 and self.to[last].get(w) == q:
                self.to[last][w] = c
                last = self.link[last]
            return c
        new = len(self.to)
        self.to.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        ends.append(set())
        while last >= 0 and w not in self.to[last]:
            self.to[last][w] = new
            last = self.link[last]
        if last >= 0:
            q = self.to[last][w]
            if self.length[q] == self.length[last] + 1:
                self.link[new] = q
            else:
                c = self._clone(q, self.length[last] + 1, ends)
                self.link[q] = self.link[new] = c
                while last >= 0 and self.to[last].get(w) == q:
                    self.to[last][w] = c
                    last = self.link[last]
        return new

    def spans(self, text: list[str]) -> dict[int, list[list[int]]]:
        """item -> [first word, last word + 1, longest match] of the merged stretches of text that the item contains."""
        to, link, length, least = self.to, self.link, self.length, self.least
        found: dict[int, list[list[int]]] = {}
        state = matched = 0
        for i, w in enumerate(map(self.vocabulary.get, text)):
            if w is None:
                state = matched = 0
                continue
            while (nxt := to[state].get(w)) is None and state:
                state = link[state]
                matched = length[state]
            if nxt is None:
                continue
            state, matched = nxt, matched + 1
            if matched >= least:
                s, m, done = state, matched, set()
                while s > 0 and m >= least:
                    for item in self.items[s]:
                        if item not in done:
                            done.add(item)
                            runs = found.setdefault(item, [])
                            if runs and i + 1 - m <= runs[-1][1]:
                                runs[-1][1] = i + 1
                                runs[-1][0] = min(runs[-1][0], i + 1 - m)
                                runs[-1][2] = max(runs[-1][2], m)
                            else:
                                runs.append([i + 1 - m, i + 1, m])
                    s = link[s]
                    m = length[s]
        return found


def _text_key() -> Column:
    return F.xxhash64("text").alias("text_key")


def _parsed(documents: DataFrame) -> DataFrame:
    """(doc_id, text_key, part, words): the words of every readable part, read once for all blocks of items."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(doc, key, part, " ".join(words(text))) for doc, key, raw in zip(b["doc_id"], b["text_key"], b["text"]) for part, text in enumerate(readable_texts(raw))]
            yield pd.DataFrame(rows, columns=["doc_id", "text_key", "part", "words"])

    return scratch.table(documents.mapInPandas(read, "doc_id long, text_key long, part int, words string"), "parsed")


def leaked_passages(documents: DataFrame, items: DataFrame, *, min_words: int = MIN_WORDS, max_cover: float = 0.5) -> DataFrame:
    """(doc_id, text_key, item_id, part, first_word, last_word, longest, doc_cover, item_cover, action).

    A row for each stretch of words of one readable text part of a document that is made up of matches of min_words or
    more consecutive words with one item. first_word to last_word (inclusive) is the stretch, longest its longest single
    match in words, doc_cover and item_cover are the shares of the part's and the item's words in all stretches of the
    two. action says what keeps training data clean: `drop document` where doc_cover exceeds max_cover, else `cut span`;
    without_leaks() does it. text_key tells texts under one doc_id apart.

    documents (doc_id, text) are raw messages; transfer encodings, mark-up and entities are undone, and words are runs
    of letters and digits without regard to case. items (item_id, text) are the stated query set: they are matched in
    blocks of at most BLOCK_WORDS words, each broadcast as one automaton and streamed over all documents, whole texts,
    which are parsed once. An item of more words than a block holds is matched in pieces that share min_words - 1 words;
    their stretches come out by themselves. Null, empty and short texts match nothing; repeated items and documents each
    match by themselves. Only doc_id and text, item_id and text are read, so other columns don't matter.
    """
    spark = documents.sparkSession
    documents = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key())
    blocks = _blocks(items, min_words)
    ahead = list(itertools.islice(blocks, 2))
    several = len(ahead) > 1
    source = _parsed(documents) if several else documents
    out = None
    for block in itertools.chain(ahead, blocks):
        sizes = {i: n for i, n, _ in block}
        shared = spark.sparkContext.broadcast((Automaton([(i, w) for i, _, w in block], min_words), sizes))

        def stream(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            automaton, sizes = shared.value
            for b in batches:
                if several:
                    parts = zip(b["doc_id"], b["text_key"], b["part"], (x.split() for x in b["words"]))
                else:
                    parts = ((doc, key, part, words(text)) for doc, key, raw in zip(b["doc_id"], b["text_key"], b["text"]) for part, text in enumerate(readable_texts(raw)))
                rows = []
                for doc, key, part, w in parts:
                    if len(w) < min_words:
                        continue
                    for item, runs in automaton.spans(w).items():
                        n = sum(r[1] - r[0] for r in runs)
                        cover, of = n / len(w), min(1.0, n / sizes[item])
                        rows += [(doc, key, item, part, r[0], r[1] - 1, r[2], cover, of, "drop document" if cover > max_cover else "cut span") for r in runs]
                yield pd.DataFrame(rows, columns=_COLUMNS)

        found = source.mapInPandas(stream, _SCHEMA)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], _SCHEMA)


_COLUMNS = ["doc_id", "text_key", "item_id", "part", "first_word", "last_word", "longest", "doc_cover", "item_cover", "action"]
_SCHEMA = "doc_id long, text_key long, item_id long, part int, first_word int, last_word int, longest int, doc_cover double, item_cover double, action string"


def _blocks(items: DataFrame, min_words: int) -> Iterator[list[tuple[int, int, list[str]]]]:
    """The query set in blocks of (item, words in the item, words); the driver holds two blocks at most."""
    block, n = [], 0
    step = max(1, BLOCK_WORDS - min_words + 1)
    for row in items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").toLocalIterator():
        w = words(row[1])
        for at in range(0, max(1, len(w) - min_words + 1), step):
            piece = w[at : at + BLOCK_WORDS]
            if n + len(piece) > BLOCK_WORDS and block:
                yield block
                block, n = [], 0
            block.append((row[0], len(w), piece))
            n += len(piece)
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, item_id), each once."""
    return leaked_passages(documents, items, min_words=min_words).select("doc_id", "item_id").distinct()


def cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without the given stretches of words (first, last), each by itself, and the number of words taken out."""
    places = word_places(text)
    out, at, gone = [], 0, set()
    for first, last in sorted(spans):
        gone.update(range(first, last + 1))
        start, end = places[first][0], places[last][1]
        if start > at:
            out.append(text[at:start])
        at = max(at, end)
    return "".join([*out, text[at:]]), len(gone)


def without_leaks(documents: DataFrame, items: DataFrame, *, min_words: int = MIN_WORDS, max_cover: float = 0.5) -> DataFrame:
    """(doc_id, part, text, removed_words): the readable parts of documents without the stretches that leak an item.

    Every stretch is cut by itself, so that the words between two of them stay; a document of which one part has more
    than max_cover of its words in stretches, of whatever items, is dropped whole. Parts of documents without leaks come
    out as they are (composed characters, NFC). Documents without doc_id, or with a null text, give no rows.
    """
    passages = leaked_passages(documents, items, min_words=min_words, max_cover=max_cover)
    spans = passages.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("part", "first_word", "last_word")).alias("spans"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key()).where("doc_id is not null and text is not null").join(spans, ["doc_id", "text_key"], "left")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, raw, found in zip(b["doc_id"], b["text"], b["spans"]):
                of: dict[int, list[tuple[int, int]]] = {}
                for x in found if found is not None else ():
                    of.setdefault(x["part"], []).append((x["first_word"], x["last_word"]))
                parts = []
                for part, text in enumerate(readable_texts(raw)):
                    text = text if text.isascii() else unicodedata.normalize("NFC", text)
                    n, (left, gone) = len(words(text)) if part in of else 0, cut(text, of[part]) if part in of else (text, 0)
                    if gone > max_cover * n:
                        parts = []
                        break
                    parts.append((doc, part, left, gone))
                out += parts
            yield pd.DataFrame(out, columns=["doc_id", "part", "text", "removed_words"])

    return rows.select("doc_id", "text", "spans").mapInPandas(clean, "doc_id long, part int, text string, removed_words int")
