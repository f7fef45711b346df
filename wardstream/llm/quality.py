"""Per-document statistics that tell prose from lists, tables and junk, and the fixed-threshold rules they fail.

A batch of texts becomes flat Arrow arrays of lines and of words, and every statistic is one vectorised
pass over them: lengths, symbols, line ends, bullets, common words, repeated lines and pairs of words, and
what share of the characters lies in lines laid out as list entries, as table rows or as no language at
all. Word features are computed once per distinct word of a batch.

Rules with fixed thresholds then give the reasons, and the kind follows from the reasons alone
(:func:`kind_of`). :data:`PUBLISHED` holds thresholds published for large web corpora. They were made to
throw away poor pages, not to name kinds, and many a short prose text fails one, so they don't suffice:
:data:`SIGNS` are signs that a text is no language, :data:`LAYOUT` says what most of it looks like. Where no
layout has half of the characters but prose has less than half too, a failed published rule decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardstream.llm.batches import slices

# Frequent function words of the four languages.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "from", "at", "which", "but", "have", "an", "had", "they", "you", "were"],
    "de": ["der", "die", "und", "den", "von", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "wenn", "wir"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "nous"],
    "et": ["ja", "on", "ei", "et", "kui", "see", "ta", "oli", "ka", "ning", "aga", "mis", "kuid", "nii", "sest"],
}

# Thresholds of published rules (massive-scale web corpora; documents fail a rule outside them).
PUBLISHED = {
    "too_few_words": "n_words < 50",
    "too_many_words": "n_words > 100000",
    "mean_word_length": "mean_word_length < 3 or mean_word_length > 10",
    "symbol_ratio": "symbol_ratio > 0.1",
    "bullet_lines": "bullet_share > 0.9",
    "ellipsis_lines": "ellipsis_share > 0.3",
    "alphabetic_words": "alpha_word_share < 0.8",
    "common_words": "n_common < 2",
    "line_ends": "end_punct_share <= 0.12",
    "short_lines": "short_line_share > 0.67",
    "repeated_lines": "repeated_line_share > 0.3",
    "repeated_pairs": "top_pair_share > 0.2",
}

SIGNS = {
    "garbled": "weird_share > 0.08",
    "rare_symbols": "rare_share > 0.12",
    "mashed_words": "n_words >= 12 and mash_share > 0.12 and common_share < 0.12",
    "few_distinct_words": "n_words >= 8 and distinct_word_share <= 0.25 and distinct_word_share <= 1.6 / sqrt(n_words)",
    "said_again": "n_sentences >= 6 and repeated_sentence_share >= 0.66",
    "one_pair": "n_words >= 20 and top_pair_share > 0.4",
}

LAYOUT = {
    "junk_lines": "junk_share >= 0.5", "table_lines": "table_share >= 0.5", "list_lines": "list_share >= 0.5",
    "partly_junk": "prose_share < 0.5 and junk_share > 0.4 and junk_share >= greatest(list_share, table_share)",
    "partly_table": "prose_share < 0.5 and table_share > 0.4 and table_share >= greatest(list_share, junk_share)",
    "partly_list": "prose_share < 0.5 and list_share > 0.4 and list_share >= greatest(table_share, junk_share)",
}
RULES = PUBLISHED | SIGNS | LAYOUT
#: Where words recur, too. Sentences are counted in every text, but said again only here are they a sign.
RECURRING = "n_words >= 8 and distinct_word_share <= 0.25"
ONLY = {"said_again": RECURRING}

_COMMON = "|".join(sorted({w for v in COMMON.values() for w in v}))
_MARK = r"(?:[-*+•‣◦·–—]|\(?[0-9]{1,3}[.):]|\(?[A-Za-z][.)]|[A-Za-z]{1,3}[0-9]+(?:[-.][0-9]+)*[.:)]|\[[ xX]\])[ \t]+"
_CELL = r"[\p{L}\p{N}_.:%+\"'/-]*"
_ROW = "^" + _CELL + "[,;]" + _CELL + r"[,;][\p{L}\p{N}_.:%+\"'/,;-]*$"
#: Lines of junk: hex dumps, rules of symbols.
_JUNK_LINE = r"^[0-9a-fA-F]{6,8}:?[ \t]+(?:[0-9a-fA-F]{2,4}[ \t]+){4}|^[^\p{L}\p{N}|]{4,}$"
#: Encoded text without blanks (unless it is a row of values).
_UNBROKEN = r"^[^\s|]{40,}$"
#: Lines of tables: delimited by pipes, ampersands, commas or semicolons without blanks, or tabs.
_TABLE_LINE = r"^\||\|[^|]*\||^\\(?:begin|end)\{|^\\(?:hline|toprule|midrule|bottomrule)|&.*\\\\$|\t[^\t]*\t"
#: Columns held apart by runs of blanks, where no words stand a single blank apart.
_COLUMNS, _SINGLE, _SPOKEN = r"^\S* {2,}\S+ {2,}", r"\S \S", " (?:" + _COMMON + ") .* (?:" + _COMMON + ") "
#: Marked entries, and those that hold a sentence.
_ENTRY = "^(?:" + _MARK + "){1,4}"
_SENTENCE = _ENTRY + r"\p{Lu}\S*(?:[ \t]+\S+){5}.*[.!?…][\"'”»)]{0,2}$"
#: Short entries that end in ; or a comma, or in a full stop without starting like a sentence; short lines without an end.
_PART, _STOP, _LOOSE = r"^(?:\S+[ \t]+){0,8}\S*[;,]$", r"^[^\p{Lu}#>\s](?:\S*[ \t]+\S+){0,8}\S*\.$", r"^[^#>\s]\S*(?:[ \t]+\S+){0,6}$"
#: Entries one after another in a line: many commas for its words, and no sentence that ends before the line does.
_COMMAS, _ENDS = (6, 0.15), r"[.!?…][\"'”»)]* "
_LOOSE_END = r"[.!?…:\"'”»)-]$"
#: Signs of broken encodings: replacement and private characters, and what UTF-8 bytes look like in another code page.
_WEIRD = r"[\x{FFFD}\x{A4}\x{A6}\x{B6}\x{BF}\x{C3}\x{E2}\x{20AC}\x{2122}\x{E000}-\x{F8FF}\x{2500}-\x{259F}]"
_RARE = r"[{}\[\]|\\^~`<>#$%&*+=@!?]"
#: Words that no language spells: five consonants in a row, a semicolon inside, a letter three times.
_MASH = r"(?i)[bcdfghjklmnpqrstvwxz]{5}|\p{L};\p{L}|" + "|".join(3 * c for c in "abcdefghijklmnopqrstuvwxyz")

_EDGES = ".,;:!?\"'()[]{}…«»“”„’‘*_>-"
_SENTENCES = r"[.!?]\s+|\n+"
_BULLET_BOX = r"\[[ xX]\]"

STATISTICS = [
    "mean_word_length", "symbol_ratio", "end_punct_share", "bullet_share", "ellipsis_share", "short_line_share", "repeated_line_share", "alpha_word_share", "common_share", "top_pair_share", "distinct_word_share",
    "repeated_sentence_share", "weird_share", "rare_share", "mash_share", "list_share", "table_share", "junk_share", "prose_share",
]
COUNTS = ["n_chars_seen", "n_words", "n_lines", "n_common", "n_sentences"]


def _flags(a: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(a, pattern).to_numpy(zero_copy_only=False)


def _ints(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in order and how often each occurs; one plain sort, which is far faster than hashing or than keeping track of places."""
    x = np.sort(x)
    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return x[at], np.diff(np.r_[at, len(x)])


def _pieces(a: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The flat values of a list array and the number of the text each came from."""
    return a.flatten(), np.repeat(np.arange(len(a)), np.diff(a.offsets.to_numpy()))


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros(len(x)), where=y > 0)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of an array of texts (null is an empty text)."""
    n = len(texts)
    raw = pc.fill_null(texts.cast(pa.string()), "")
    t = pc.replace_substring(pc.replace_substring(raw, "\r\n", "\n"), "\r", "\n")
    t = pc.replace_substring(pc.replace_substring(pc.replace_substring(t, "﻿", ""), "​", ""), " ", " ")
    count = lambda doc, w=None: np.bincount(doc, w, n) if len(doc) else np.zeros(n)
    out = {"n_chars_seen": _ints(pc.utf8_length(raw))}

    # Lines, without blank ones.
    line, doc = _pieces(pc.split_pattern(t, "\n"))
    line = pc.ascii_trim_whitespace(line)
    full = pc.not_equal(line, "")
    line, doc = line.filter(full), doc[full.to_numpy(zero_copy_only=False)]
    size = _ints(pc.utf8_length(line))
    chars, lines = count(doc, size), count(doc)
    follows = np.r_[False, doc[1:] == doc[:-1]] if len(doc) else np.zeros(0, bool)
    code = _ints(pc.dictionary_encode(line).indices) if len(line) else np.zeros(0, np.int64)
    distinct = count(_tally(doc * (1 << 32) + code)[0] >> 32)
    bare = pc.utf8_ltrim(line, "> \t")
    entry = _flags(line, _ENTRY)
    out |= {
        "n_lines": lines.astype(np.int64), "end_punct_share": _ratio(count(doc[_flags(line, r"[.!?…][\"'”»)]*$")]), lines), "bullet_share": _ratio(count(doc[entry]), lines),
        "ellipsis_share": _ratio(count(doc[_flags(line, r"(?:\.\.\.|…)$")]), lines), "short_line_share": _ratio(count(doc[size < 30]), lines), "repeated_line_share": _ratio(lines - distinct, lines),
    }

    # Layout: what a line is taken for first, it stays.
    row = _flags(line, _ROW)
    again = follows & (size >= 3) & np.r_[False, code[1:] == code[:-1]] if len(code) else follows
    junk = _flags(line, _JUNK_LINE) | (_flags(line, _UNBROKEN) & ~row) | again | np.r_[again[1:], False] if len(code) else follows
    table = ~junk & (row | _flags(line, _TABLE_LINE) | (_flags(line, _COLUMNS) & ~_flags(line, _SINGLE) & ~_flags(line, _SPOKEN)))
    left = ~junk & ~table
    closed = ~follows | np.r_[False, _flags(line, r"[.;:!?]$")[:-1]] if len(code) else follows
    commas = _ints(pc.count_substring(line, ","))
    many = np.flatnonzero(commas >= _COMMAS[0])
    strung, some = np.zeros(len(commas), bool), line.take(pa.array(many))
    strung[many] = (commas[many] >= _COMMAS[1] * (_ints(pc.count_substring_regex(some, r"[ \t]+")) + 1)) & ~_flags(some, _ENDS)
    entries = left & (strung | (_flags(bare, _ENTRY) & ~_flags(bare, _SENTENCE)) | _flags(bare, _PART) | (_flags(line, _STOP) & closed))
    loose = left & ~entries & _flags(line, _LOOSE) & ~_flags(line, _LOOSE_END)
    n_loose, in_loose = count(doc[loose]), count(doc[loose], size[loose])
    in_list = count(doc[entries], size[entries])
    in_list = np.where(n_loose >= 4, in_list + in_loose, in_list)  # short lines without an end are entries if there are at least four
    in_table, in_junk = count(doc[table], size[table]), count(doc[junk], size[junk])

    # Words, each distinct one looked at once.
    word, at = _pieces(pc.ascii_split_whitespace(t))
    full = pc.not_equal(word, "")
    word, at = pc.dictionary_encode(word.filter(full)), at[full.to_numpy(zero_copy_only=False)]
    kinds = word.dictionary
    v, ix = max(1, len(kinds)), _ints(word.indices)
    low = pc.utf8_trim(pc.utf8_lower(kinds), ".,;:!?\"'()[]{}…«»“”„’‘*_>-")
    w_size = _ints(pc.utf8_length(kinds))
    words, solid = count(at), count(at, w_size[ix])
    common = count(at[pc.is_in(low, pa.array(sorted({w for c in COMMON.values() for w in c}))).to_numpy(zero_copy_only=False)[ix]])
    mash = count(at[_flags(kinds, _MASH)[ix]])
    vocabulary = count(_tally(at * v + ix)[0] // v)
    if v * v * n >= 2**63 and n > 1:  # numbers of pairs would not fit
        halves = [measure(texts.slice(0, n // 2)), measure(texts.slice(n // 2))]
        return {k: np.concatenate([h[k] for h in halves]) for k in halves[0]}
    two = np.flatnonzero(at[1:] == at[:-1]) if len(at) else np.zeros(0, np.int64)
    pair, times = _tally((at[two] * v + ix[two]) * v + ix[two + 1])
    pair, times = pair[times > 1], times[times > 1]
    top = np.zeros(n)
    np.maximum.at(top, pair // (v * v), times * (w_size[pair // v % v] + w_size[pair % v]))
    out |= {
        "n_words": words.astype(np.int64), "n_common": common.astype(np.int64), "mean_word_length": _ratio(solid, words), "alpha_word_share": _ratio(count(at[_flags(kinds, r"\p{L}")[ix]]), words),
        "common_share": _ratio(common, words), "symbol_ratio": _ratio(_ints(pc.count_substring_regex(t, r"#|\.\.\.|…")), words), "top_pair_share": _ratio(top, solid),
    }

    # Sentences of every text with words, and signs of no language.
    sentence, of = _pieces(pc.split_pattern_regex(t, _SENTENCES))
    tag = _ints(pc.dictionary_encode(pc.ascii_trim_whitespace(sentence)).indices)
    parts, said = np.where(words > 0, count(of), 0), np.where(words > 0, count(_tally(of * (1 << 32) + tag)[0] >> 32), 0)
    rare = _ints(pc.count_substring_regex(t, _RARE)) - 2 * _ints(pc.count_substring_regex(t, _BULLET_BOX))
    out |= {
        "distinct_word_share": _ratio(vocabulary, words), "n_sentences": parts.astype(np.int64), "repeated_sentence_share": _ratio(parts - said, parts), "weird_share": _ratio(_ints(pc.count_substring_regex(t, _WEIRD)), chars),
        "rare_share": _ratio(rare, chars), "mash_share": _ratio(mash, words), "list_share": _ratio(in_list, chars), "table_share": _ratio(in_table, chars), "junk_share": _ratio(in_junk, chars),
    }
    return out | {"prose_share": _ratio(chars - in_list - in_table - in_junk, chars)}


def text_quality(documents: DataFrame) -> DataFrame:
    """Statistics, failed rules and kind of every document.

    Columns: ``doc_id``; the counts and shares of :data:`COUNTS` and :data:`STATISTICS` (``top_pair_share``:
    characters in the pair of words that takes most, of those that recur; ``list_share``, ``table_share``,
    ``junk_share``, ``prose_share``: characters by the layout of their line); ``reasons`` (failed rules, in
    the order of :data:`RULES`) and ``kind`` (list, table, junk, or prose; null for null and blank texts,
    whose figures are 0 and which fail no rule).
    Lines end at LF, CR or CRLF; blank lines and byte-order marks don't count. Repeated rows are rated
    each; texts are read whole; other columns are ignored.
    """
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(_ints(pc.fill_null(pc.binary_length(whole.column(1)), 0))):
                b = whole.slice(i, j - i)
                m = measure(b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(m[c]) for c in (*COUNTS, *STATISTICS))], names=["doc_id", *COUNTS, *STATISTICS])

    s = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    reasons = F.array_compact(F.array(*[F.when(F.expr(f"({r}) and ({ONLY.get(n, 'true')})"), F.lit(n)) for n, r in RULES.items()]))
    return s.withColumn("reasons", F.when(F.col("n_words") > 0, reasons).otherwise(F.array().cast("array<string>"))).withColumn("kind", F.expr(kind_of("reasons", "n_words")))


def kind_of(reasons: str, n_words: str) -> str:
    """SQL: the kind from the reasons. Junk, table and list by what half of the characters look like, junk also by any sign, then partly with a failed published rule."""
    has = lambda r: f"array_contains({reasons}, '{r}')"
    any_ = lambda rules: "(" + " or ".join(map(has, rules)) + ")"
    partly = " ".join(f"when {has('partly_' + k)} and {any_(PUBLISHED)} then '{k}'" for k in ("junk", "table", "list"))
    return f"case when {n_words} = 0 then null when {has('junk_lines')} then 'junk' when {has('table_lines')} then 'table' when {any_(SIGNS)} then 'junk' when {has('list_lines')} then 'list' {partly} else 'prose' end"


def not_prose(documents: DataFrame) -> DataFrame:
    """``doc_id, kind`` of the documents that are a list, a table or junk, decided by :func:`text_quality`."""
    return text_quality(documents).select("doc_id", "kind").where("kind <> 'prose'")
