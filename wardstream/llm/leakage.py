"""Test passages inside training texts, by a generalised suffix automaton over words.

The passages are normalised to words and dealt, by a hash, into blocks of bounded size. Tasks build one
automaton per block and keep it as flat arrays. Training documents then stream past: a batch of documents
is one sequence of word numbers with breaks between texts, cut into lanes of equal length that advance
together, one word a step, so that NumPy follows all matches at once. A lane starts ``run`` - 1 words early,
which is all that the longest match of at least ``run`` words (or a whole shorter passage) at its first word
depends on. The work is linear in the words and does not depend on the number of passages; documents are
never joined with one another.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.llm.batches import slices
from wardstream.runtime import stored

RUN = 13
#: Words of passages per automaton, about (passages are dealt whole).
BLOCK_WORDS = 200_000
#: Bytes of automata that a worker holds at once. More are streamed over in another pass.
PASS_BYTES = 256_000_000
LANE = 256
_GONE = {0x00AD: None, 0x200B: None}
_WORD = re.compile("[a-z0-9]+")


def words(text: str) -> list[str]:
    """Words of a text: U+00AD and U+200B removed, lower case, longest stretches of a-z and 0-9."""
    if not text.isascii():
        text = text.replace("\u00ad", "").replace("\u200b", "")
    return _WORD.findall(text.lower())


def word_spans(text: str) -> list[tuple[str, int, int]]:
    """Words with their place in the text as it stands (a letter that lower-casing lengthens keeps its place)."""
    chars, place = [], []
    for i, ch in enumerate(text):
        if ord(ch) in _GONE:
            continue
        low = ch.lower()
        chars.append(low)
        place.extend([i] * len(low))
    return [(m.group(), place[m.start()], place[m.end() - 1] + 1) for m in _WORD.finditer("".join(chars))]


class Builder:
    """Suffix automaton of several word sequences; every state knows the passages whose text holds its runs."""

    def __init__(self, passages: list[list[str]], run: int = RUN) -> None:
        """``passages``: words of each; empty ones never match."""
        self.run = run
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        for seq in passages:
            last = 0
            for w in seq:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
        # A second walk marks states, as cloning during construction moves them.
        marks: dict[int, set[int]] = {}
        ends: dict[int, set[int]] = {}
        self.size = [min(len(seq), run) for seq in passages]
        for i, seq in enumerate(passages):
            s = 0
            for w in seq:
                s = self.next[s][self.vocabulary[w]]
                if len(seq) >= run:
                    marks.setdefault(s, set()).add(i)
            if seq and len(seq) < run:
                ends.setdefault(s, set()).add(i)
        order = sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True)
        held: list[set[int] | None] = [marks.get(s) for s in range(len(self.link))]
        for s in order:  # a suffix occurs wherever the longer run does
            p = self.link[s]
            if held[s] and p > 0 and self.length[p] >= run:
                held[p] = (held[p] or set()) | held[s]
        #: Per state: passages that hold the last ``run`` words of a match in it, and shorter passages that can end in it.
        self.hits: list[frozenset] = [frozenset()] * len(self.link)
        short: list[frozenset] = [frozenset()] * len(self.link)
        long: list[frozenset] = [frozenset()] * len(self.link)
        for s in reversed(order):
            p = self.link[s]
            if self.length[s] >= run:
                long[s] = long[p] if self.length[p] >= run else frozenset(held[s] or ())
            short[s] = short[p] | ends[s] if s in ends else short[p]
            self.hits[s] = long[s] | short[s] if short[s] else long[s]

    def flat(self) -> dict:
        """The automaton as arrays: transitions by (state, word), links, lengths, and the distinct sets of passages."""
        v = max(1, len(self.vocabulary))
        keys = np.array([s * v + c for s, t in enumerate(self.next) for c in t], dtype=np.int64)
        to = np.array([q for t in self.next for q in t.values()], dtype=np.int32)
        order = np.argsort(keys)
        sets: dict[frozenset, int] = {frozenset(): 0}
        which = np.array([sets.setdefault(h, len(sets)) for h in self.hits], dtype=np.int32)
        return {
            "words": list(self.vocabulary), "keys": keys[order], "to": to[order], "link": np.array(self.link, dtype=np.int32), "length": np.array(self.length, dtype=np.int32), "set": which,
            "at": np.cumsum([0, *map(len, sets)]), "members": np.array([i for h in sets for i in sorted(h)], dtype=np.int32), "size": np.array(self.size, dtype=np.int32),
        }

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = len(link)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _clone(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new


class Automaton:
    """A block's arrays, ready to follow many texts at once."""

    def __init__(self, flat: dict, items: list[list[int]], run: int) -> None:
        self.__dict__.update(flat)
        self.items, self.run, self.v = items, run, max(1, len(self.words))
        self.root = np.zeros(self.v, dtype=np.int32)
        first = self.keys[: np.searchsorted(self.keys, self.v)]
        self.root[first] = self.to[: len(first)]

    def follow(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and states at which a run of ``run`` words or a whole shorter passage may end; ``ids`` are word numbers, -1 for others and between texts."""
        n, warm = len(ids), self.run - 1
        lanes = -(-n // LANE)
        padded = np.full(warm + lanes * LANE, -1, dtype=np.int64)
        padded[warm : warm + n] = ids
        start = np.arange(lanes) * LANE
        s, m = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        at, states = [], []
        for k in range(warm + LANE):
            c = padded[start + k]
            known = c >= 0
            s[~known], m[~known] = 0, 0
            todo = np.flatnonzero(known)
            while len(todo):
                root = s[todo] == 0
                r = todo[root]
                s[r], m[r] = self.root[c[r]], 1
                todo = todo[~root]
                if not len(todo):
                    break
                key = s[todo] * self.v + c[todo]
                i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                ok = self.keys[i] == key
                hit = todo[ok]
                s[hit] = self.to[i[ok]]
                m[hit] += 1
                todo = todo[~ok]
                s[todo] = self.link[s[todo]]
                m[todo] = self.length[s[todo]]
            if k >= warm:
                got = np.flatnonzero((self.set[s] > 0) & known)
                if len(got):
                    at.append(start[got] + k - warm)
                    states.append(np.stack([s[got], m[got]]))
        if not at:
            return np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        at, states = np.concatenate(at), np.concatenate(states, axis=1)
        order = np.argsort(at, kind="stable")
        return at[order], states[:, order]

    def runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, first and last word of every run of ``run`` words, or whole shorter passage, found in the sequence."""
        at, (state, m) = self.follow(ids)
        which = self.set[state]
        n = (self.at[which + 1] - self.at[which]).astype(np.int64)
        row = np.repeat(np.arange(len(at)), n)
        inside = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        p = self.members[self.at[which[row]] + inside]
        size = self.size[p]
        ok = size <= m[row]
        p, end, size = p[ok], at[row[ok]], size[ok]
        return p, end - size + 1, end


def _stretches(group: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unbroken stretches covered by runs of one length per group: group, first and last word."""
    order = np.lexsort((last, group))
    g, a, b = group[order], first[order], last[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (a[1:] > b[:-1] + 1)] if len(g) else np.zeros(0, bool)
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(g)] - 1 if len(start) else start
    return g[start], a[start], b[end]


def automata(items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The test set as automata: ``block, flat`` (arrays and items, pickled), a table in the shared folder.

    Equal passages are one passage with several items. Null passages and those without words are left out.
    """
    one = items.select(F.col("item_id").cast("long").alias("item_id"), "passage").where("passage is not null")
    total = one.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0]
    n = max(1, -(-total // (6 * block_words)))  # a word and its blank have about six characters

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        by: dict[tuple, list[int]] = {}
        for item, text in sorted(zip(pdf["item_id"], pdf["passage"])):
            if w := words(text):
                by.setdefault(tuple(w), []).append(int(item))
        data = pickle.dumps((Builder([list(w) for w in by], run).flat(), list(by.values())))
        return pd.DataFrame({"block": [int(key[0])], "flat": [data], "bytes": [len(data)]})

    return stored(one.groupBy(F.pmod(F.xxhash64("passage"), F.lit(n)).alias("block")).applyInPandas(build, "block long, flat binary, bytes long"), "automata")


def passes(table: DataFrame, most: int = PASS_BYTES) -> list[list[bytes]]:
    """The automata in groups of at most ``most`` bytes (or one automaton), each fetched on its own."""
    sizes = sorted((r.block, r.bytes) for r in table.select("block", "bytes").collect())
    groups, n = [[]], 0
    for block, size in sizes:
        if groups[-1] and n + size > most:
            groups.append([])
            n = 0
        groups[-1].append(block)
        n += size
    return [[r.flat for r in table.where(F.col("block").isin(g)).select("flat").collect()] for g in groups if g]


class Screen:
    """All automata of one pass, with one dictionary of words."""

    def __init__(self, blocks: list[bytes], run: int) -> None:
        self.automata = [Automaton(*pickle.loads(b), run) for b in blocks]
        self.number: dict[str, int] = {}
        for a in self.automata:
            for w in a.words:
                self.number.setdefault(w, len(self.number))
        self.map = []
        for a in self.automata:  # word number of the pass -> of the block; the last place is for words that no passage has
            m = np.full(len(self.number) + 1, -1, dtype=np.int64)
            m[[self.number[w] for w in a.words]] = np.arange(len(a.words))
            self.map.append(m)

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts in a row with a break after each; where each begins; words of each."""
        get, ids, n = self.number.get, [], []
        for t in texts:
            w = words(t) if t else []
            ids.extend([get(x, -1) for x in w])
            ids.append(-1)
            n.append(len(w))
        n = np.array(n, dtype=np.int64)
        return np.array(ids, dtype=np.int64), np.cumsum(n + 1) - n - 1, n

    def leaks(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, item, longest stretch, covered words and the text's words, one entry per text and item."""
        ids, begin, n = self.read(texts)
        out = []
        for a, m in zip(self.automata, self.map):
            p, first, last = a.runs(m[ids])
            if not len(p):
                continue
            doc = np.searchsorted(begin, first, side="right") - 1
            g, x, y = _stretches(doc * len(a.items) + p, first, last)
            at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            longest, cover = np.maximum.reduceat(y - x + 1, at), np.add.reduceat(y - x + 1, at)
            d, p = np.divmod(g[at], len(a.items))
            copies = np.array([len(a.items[i]) for i in p])
            item = np.array([i for q in p for i in a.items[q]], dtype=np.int64)
            out.append((np.repeat(d, copies), item, np.repeat(longest, copies), np.repeat(cover, copies)))
        if not out:
            return (np.zeros(0, np.int64),) * 5
        d, item, longest, cover = (np.concatenate(c) for c in zip(*out))
        return d, item, longest, cover, n[d]

    def spans(self, texts: list[str | None]) -> list[list[int]]:
        """Per text the covered words as first, last, first, last ..."""
        ids, begin, _ = self.read(texts)
        out: list[list[int]] = [[] for _ in texts]
        for a, m in zip(self.automata, self.map):
            p, first, last = a.runs(m[ids])
            g, x, y = _stretches(p.astype(np.int64), first, last)
            for d, u, v in zip(np.searchsorted(begin, x, side="right") - 1, x, y):
                out[d] += [int(u - begin[d]), int(v - begin[d])]
        return out


_SCREENS: dict[str, Screen] = {}


def _screen(key: str, blocks, run: int) -> Screen:
    """The automata of a pass, unpacked once per Python worker."""
    if key not in _SCREENS:
        _SCREENS.clear()
        _SCREENS[key] = Screen(blocks.value, run)
    return _SCREENS[key]


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Documents that share at least ``run`` consecutive words with a passage, or all words of a shorter one.

    Result, one row per document and item: ``doc_id, item_id, longest_run`` (words of the longest unbroken
    stretch covered by the item), ``covered_words``, ``n_words``. Null texts, null passages and passages
    without words give no rows; an item's equal passages are reported under each id; texts are read whole.
    A test set beyond ``pass_bytes`` of automata takes another pass over the documents for each further part.
    """
    spark = documents.sparkSession
    schema = "doc_id long, item_id long, longest_run int, covered_words int, n_words int"
    names = ["doc_id", "item_id", "longest_run", "covered_words", "n_words"]
    out = spark.createDataFrame([], schema)
    for i, group in enumerate(passes(automata(items, run, block_words), pass_bytes)):
        shared, key = spark.sparkContext.broadcast(group), uuid.uuid4().hex  # at most pass_bytes, or one automaton

        def scan(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            s = _screen(key, shared, run)
            for pdf in batches:
                for i, j in slices(pdf["text"].str.len().to_numpy()):
                    part = pdf.iloc[i:j]
                    d, *rest = s.leaks(part["text"].tolist())
                    yield pd.DataFrame(dict(zip(names, [part["doc_id"].to_numpy()[d], *rest])))

        part = documents.select("doc_id", "text").where("text is not null").mapInPandas(scan, schema)
        out = part if not i else out.unionByName(part)
    return out


def _clean(text: str, spans: list[int], max_coverage: float) -> tuple[str | None, int, int, bool]:
    """Text without the words ``first, last, first, last ...``, spans, characters gone, and whether all went."""
    pairs = sorted(zip(spans[::2], spans[1::2]))
    merged: list[list[int]] = []
    for a, b in pairs:
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    place = word_spans(text)
    if sum(b - a + 1 for a, b in merged) > max_coverage * len(place):
        return None, len(merged), len(text), True
    kept, at = [], 0
    for a, b in merged:
        kept.append(text[at : place[a][1]])
        at = place[b][2]
    new = "".join([*kept, text[at:]])
    return new, len(merged), len(text) - len(new), False


def remove_leaks(documents: DataFrame, items: DataFrame, run: int = RUN, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """Documents without their leaked spans: ``doc_id, text, n_spans, removed_chars, dropped``.

    Every stretch of words that belongs to a leaked run of any item is cut from the text. Where more than
    ``max_coverage`` of a document's words leaked, the whole text goes (``dropped``, text null). Null texts
    stay null. Where the automata exceed ``pass_bytes``, the parts follow one another inside each task,
    handing the spans on, so the documents are still read once and are never shuffled.
    """
    spark = documents.sparkSession
    d = documents.select("doc_id", "text", F.array().cast("array<int>").alias("spans"))
    for group in passes(automata(items, run, block_words), pass_bytes):
        shared, key = spark.sparkContext.broadcast(group), uuid.uuid4().hex  # at most pass_bytes, or one automaton

        def mark(batches: Iterator[pd.DataFrame], shared=shared, key=key) -> Iterator[pd.DataFrame]:
            s = _screen(key, shared, run)
            for pdf in batches:
                for i, j in slices(pdf["text"].str.len().fillna(0).to_numpy()):
                    part = pdf.iloc[i:j]
                    new = s.spans(part["text"].tolist())
                    yield part.assign(spans=[[*a, *b] for a, b in zip(part["spans"], new)])

        d = d.mapInPandas(mark, "doc_id long, text string, spans array<int>")

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(doc, *(_clean(text, list(sp), max_coverage) if len(sp) else (text, 0, 0, False))) for doc, text, sp in zip(pdf["doc_id"], pdf["text"], pdf["spans"])]
            yield pd.DataFrame(rows, columns=["doc_id", "text", "n_spans", "removed_chars", "dropped"])

    return d.mapInPandas(clean, "doc_id long, text string, n_spans int, removed_chars int, dropped boolean")
