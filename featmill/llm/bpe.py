"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The corpus' frequent words, as they stand between white space, are merged once, on the driver, and compiled into a
minimal acyclic automaton over their UTF-8 bytes: words share their beginnings and, because equal states are merged,
their ends. A transition carries the number of words that sort before it, so a walk adds up to the word's index, and
the index leads to the word's ids. The automaton is a few flat arrays in one buffer; tasks write it to an unnamed
temporary file and memory-map it.

A batch's texts are cut at white space and its distinct words walk through the automaton together, a byte at a step.
Those it does not have are split by the tokenizer's own pattern, and the parts merged exactly, lowest rank first. Ids and
decoded text are then put together from those of the distinct words, all in flat arrays.

Word counts cover the whole corpus; the lexicon's size only decides how many words take the fast way.
"""

from __future__ import annotations

import heapq
import json
import re
import tempfile
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from featmill.llm.common import materialize

# Words in the lexicon, their most bytes; words a task counts or remembers at a time; rows given back at a time; bytes of
# text handled at a time.
WORDS, LONGEST, HELD, ROWS, BYTES = 1 << 16, 48, 300_000, 10_000, 2 << 20
_SHORT = 24
_END = "</w>"
# White space of Unicode (fixed values).
_SPACE = "\t-\r \x85\xa0  -     　"

# Letters, numbers and capitals that came with Unicode 16 and 17, which the tokenizers library knows and Python's
# tables may not (fixed values).
LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
LATER_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
LATER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
    0xA7DC: 0x19B, **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
_LOWER = LATER_LOWER | {ord("Σ"): "σ"}
_LAST_SHORT = 0xFFFF  # the last code point that one unit of UTF-16 holds


def _class(first: str, later: tuple, most: int) -> str:
    """The code points up to ``most`` whose general category starts with ``first``, as ranges of a character class."""
    ranges, start = [f"\\U{a:08x}-\\U{b:08x}" for a, b in later if b <= most], None
    for c in range(most + 2):
        inside = c <= most and unicodedata.category(chr(c))[0] == first
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(ranges)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Tokenizer:
    """What a vocabulary file says: special tokens, the split pattern, symbols and merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        vocabulary = said["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in said["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for word, i in chain(vocabulary.items(), self.special.items()):
            self.tokens[i] = word
        self.ranks = {(vocabulary[a], vocabulary[b]): rank for rank, (a, b) in enumerate(merges)}
        self.made = [vocabulary[a + b] for a, b in merges]
        letters = _byte_letters()
        self.inner = [vocabulary[x] for x in letters]
        self.last = [vocabulary[x + _END] for x in letters]
        # Matching is several times faster where a class ends with the code points of one UTF-16 unit.
        self.patterns = tuple(
            f"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{number}]|[^{_SPACE}{letter}{number}]+"
            for letter, number in (
                (_class("L", LATER_LETTERS, most), _class("N", LATER_NUMBERS, most)) for most in (_LAST_SHORT, 0x10FFFF)
            )
        )
        self.rare = "[" + "".join(f"\\U{c:08x}" for c in sorted(_LOWER)) + "]"
        self.split = "(" + "|".join(re.escape(t) for t in self.special) + ")"

    def splitter(self) -> Callable[..., list[str]]:
        """A function that gives a text's words in order, none for a null text.

        Special tokens, which are found before anything is changed, stand for themselves. With ``lines``, line ends between
        words are given too.
        """
        short, wide = (re.compile(p).findall for p in self.patterns)
        on_lines = re.compile(self.patterns[0] + "|\n").findall
        special, rare = re.compile(self.split).split, re.compile(self.rare).search

        def plain(text: str, lines: bool = False) -> list[str]:
            near = on_lines if lines else short
            if text.isascii():
                return near(text.lower())
            text = unicodedata.normalize("NFC", text)
            # Lower case letter by letter: only some capitals need more than Python's own rule.
            text = (text.translate(_LOWER) if rare(text) else text).lower()
            return near(text) if lines or len(text.encode("utf-16-le")) == 2 * len(text) else wide(text)

        def words(text: str | None, lines: bool = False) -> list[str]:
            if not text:
                return []
            if lines:
                return plain(text, True)
            if "<|" not in text:
                return plain(text)
            return [w for k, part in enumerate(special(text)) for w in ([part] if k % 2 else plain(part))]

        return words

    def merge(self, word: str) -> tuple[int, ...]:
        """The ids of one word: the pair of lowest rank is merged first, of equal ones the leftmost."""
        if word in self.special:
            return (self.special[word],)
        data = word.encode()
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return tuple(self._merge_short(ids) if len(ids) <= _SHORT else self._merge_long(ids))

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank_of, made = self.ranks.get, self.made
        none = len(made)
        ranks = [rank_of(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            ids[k : k + 2] = [made[best]]
            del ranks[k]
            # Only the pairs beside the new symbol have changed.
            if k:
                ranks[k - 1] = rank_of((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank_of((ids[k], ids[k + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and linked neighbours, in n log n steps."""
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, *pair) for k, pair in enumerate(zip(ids, ids[1:])) if (r := self.ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right < 0 or ids[right] != b:
                continue
            ids[k], ids[right] = self.made[rank], -1
            after[k] = after[right]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := self.ranks.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]


def compile_lexicon(words: dict[str, tuple[int, ...]]) -> bytes:
    """A minimal acyclic automaton over the words' bytes with the words' ids, as one buffer.

    Words are added in byte order; a state is frozen when no later word can change it, and replaced by an equal frozen
    one where there is one.
    """
    listed = sorted((w.encode(), ids) for w, ids in words.items())
    frozen: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []  # of each frozen state: whether it ends a word; (byte, target) in order
    path: list[list] = [[False, []]]  # states on the way of the last word
    last = b""

    def freeze(depth: int) -> None:
        while len(path) > depth + 1:
            final, out = path.pop()
            key = (final, tuple(out))
            if key not in frozen:
                frozen[key] = len(states)
                states.append(key)
            path[-1][1][-1] = (path[-1][1][-1][0], frozen[key])

    for word, _ in listed:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        freeze(shared)
        for b in word[shared:]:
            path[-1][1].append((b, None))
            path.append([False, []])
        path[-1][0] = True
        last = word
    freeze(0)
    root = len(states)
    states.append((path[0][0], tuple(path[0][1])))

    below = []  # words that a state leads to; targets come before their sources
    keys, targets, skips = [], [], []
    for s, (final, out) in enumerate(states):
        n = int(final)
        for b, target in out:
            keys.append(s << 8 | b)
            targets.append(target)
            skips.append(n)
            n += below[target]
        below.append(n)
    ids = [i for _, own in listed for i in own]
    starts = np.cumsum([0, *[len(own) for _, own in listed]])
    parts = [
        np.array([root, len(states), len(keys), len(listed), len(ids)], "<i8"),
        np.array(keys, "<i8"), np.array(targets, "<i8"), np.array(skips, "<i8"),
        np.array([final for final, _ in states], "<i8"), starts.astype("<i8"), np.array(ids, "<i8"),
    ]
    return b"".join(p.tobytes() for p in parts)


class Lexicon:
    """A compiled lexicon, memory-mapped from an unnamed temporary file of the task."""

    def __init__(self, compiled: bytes) -> None:
        file = tempfile.TemporaryFile()
        file.write(compiled)
        file.flush()
        whole = np.memmap(file, "<i8", "r")
        self.root, n_states, n_keys, n_words, n_ids = map(int, whole[:5])
        ends = np.cumsum([5, n_keys, n_keys, n_keys, n_states, n_words + 1, n_ids])
        self.keys, self.targets, self.skips, self.finals, self.starts, self.ids = (
            whole[a:b] for a, b in zip(ends, ends[1:])
        )

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each word its index in the lexicon, -1 for those it does not have."""
        if not len(words):
            return np.zeros(0, np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        out = np.full(len(words), -1, np.int64)
        going = np.flatnonzero((lengths <= LONGEST) & (len(self.keys) > 0))
        state, index = np.full(len(going), self.root, np.int64), np.zeros(len(going), np.int64)
        step = 0
        while len(going):
            ended = lengths[going] == step
            found = ended & (self.finals[state] == 1)
            out[going[found]] = index[found]
            going, state, index = going[~ended], state[~ended], index[~ended]
            key = state << 8 | data[starts[going] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            going, at = going[hit], at[hit]
            state, index = self.targets[at], index[hit] + self.skips[at]
            step += 1
        return out

    def find(self, words: list[str]) -> list[tuple[int, ...] | None]:
        """The ids of each word, None for those the lexicon does not have."""
        at = self.places(pa.array(words, pa.string()))
        return [tuple(self.ids[self.starts[k] : self.starts[k + 1]].tolist()) if k >= 0 else None for k in at.tolist()]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of stretches one after another: ``starts[0]``, ``starts[0] + 1`` and so on."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about two megabytes of text, its last column; a longer text is alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + BYTES, "right")))
        yield batch.slice(start, end - start)
        start = end


def chunks(texts: pa.Array) -> pa.ListArray:
    """What stands between ASCII white space in each text, A-Z in lower case; it may be empty at the ends.

    Words never reach over white space, and what a chunk's words are does not depend on the chunks around it. Lower
    case changes no word's ids, except where a text may have special tokens, which are told apart by case.
    """
    texts = pc.fill_null(texts, "")
    return pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))


def frequent_words(docs: DataFrame, limit: int = WORDS) -> list[str]:
    """The most frequent chunks of all texts, up to ``limit``: all that occur as often as some number, twice at least.

    Chunks over 48 bytes are left out. The number is found from a histogram of a few hundred rows, so that nothing is
    sorted and no task meets more than its share.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.TableGroupBy(pa.concat_tables(held), "word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in batches:
            for part in pieces(batch):
                found = pc.value_counts(chunks(part.column(0)).flatten())
                table = pa.table({"word": found.field(0), "n": found.field(1)})
                size = pc.binary_length(table["word"])
                held.append(table.filter(pc.and_(pc.greater(size, 0), pc.less_equal(size, LONGEST))))
                if sum(map(len, held)) > HELD:
                    held[:] = [merged()]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().to_batches(ROWS)
        if held:
            yield from merged().to_batches(ROWS)

    counted = docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    # Filtered as a written table: a condition here would have the optimiser follow it through all that docs comes from.
    counted = materialize(counted, "words").where("n > 1")
    steps = counted.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least"))
    least, total = None, 0
    for row in sorted(steps.collect(), key=lambda r: -r["step"]):
        total += row["words"]
        if total > limit:
            break
        least = row["least"]
    if least is None:
        return []
    return [r["word"] for r in counted.where(F.col("n") >= least).select("word").toLocalIterator()]


class Merges:
    """Merges many words side by side: one merge of each word at a step, so that all get shorter together."""

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.merge = tokenizer.merge
        pairs = np.array([(a, b, rank) for (a, b), rank in tokenizer.ranks.items()], np.int64).reshape(-1, 3)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.by_key = keys[order], pairs[order, 2]
        self.made, self.none = np.array(tokenizer.made, np.int64), len(tokenizer.made)
        self.inner, self.last = np.array(tokenizer.inner, np.int64), np.array(tokenizer.last, np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, ``none`` where there is no such merge or no right symbol."""
        if not len(self.keys):
            return np.full(left.shape, self.none)
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.by_key[at], self.none)

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after another, and their numbers. Special tokens and long words are merged one by one."""
        sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        rare = pc.or_(pc.starts_with(words, "<|"), pa.array(sizes > LONGEST)).to_numpy(zero_copy_only=False)
        lengths, found = np.zeros(len(words), np.int64), []
        for k in np.flatnonzero(rare):
            own = self.merge(words[int(k)].as_py())
            lengths[k] = len(own)
            found.append((np.array([k]), np.array([own], np.int64)))
        plain = np.flatnonzero(~rare & (sizes > 0))
        plain = plain[np.argsort(sizes[plain], kind="stable")]
        offsets = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else None
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8) if len(words) else None
        # Words of about the same length lie in one block.
        for block in np.array_split(plain, max(1, len(plain) >> 13)):
            if len(block):
                for rows, ids in self._block(block, offsets, data, sizes):
                    lengths[rows] = ids.shape[1]
                    found.append((rows, ids))
        out, begins = np.empty(lengths.sum(), np.int64), np.cumsum(lengths) - lengths
        for rows, ids in found:
            out[begins[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, lengths

    def _block(self, rows: np.ndarray, offsets: np.ndarray, data: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(rows, ids)`` of words with the same number of ids."""
        size, width = sizes[rows], int(sizes[rows].max())
        column = np.arange(width)
        raw = data[np.minimum(offsets[rows][:, None] + column, len(data) - 1)]
        ids = np.where(column == size[:, None] - 1, self.last[raw], self.inner[raw])
        ids[column >= size[:, None]] = -1
        ranks = self.ranks(ids[:, :-1], ids[:, 1:])
        while True:
            if ids.shape[1] > 1:
                best = ranks.argmin(axis=1)
                line = np.arange(len(rows))
                lowest = ranks[line, best]
                done = lowest == self.none
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                number = (ids[done] >= 0).sum(axis=1)
                for n in np.unique(number):
                    same = number == n
                    yield rows[done][same], ids[done][same][:, :n]
                rows, ids = rows[~done], ids[~done]
                if not len(rows):
                    return
                ranks, best, lowest = ranks[~done], best[~done], lowest[~done]
                line = np.arange(len(rows))
            # Every word left has a pair to merge: put in the new symbol, close the gap, look up the pairs beside it.
            ids[line, best] = self.made[lowest]
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > best[:, None]), 1)
            column = column[:-1]
            ranks = np.take_along_axis(ranks, column + (column >= best[:, None]), 1)
            inside = np.flatnonzero(best < ids.shape[1] - 1)
            ranks[inside, best[inside]] = self.ranks(ids[inside, best[inside]], ids[inside, best[inside] + 1])
            inside = np.flatnonzero(best > 0)
            ranks[inside, best[inside] - 1] = self.ranks(ids[inside, best[inside] - 1], ids[inside, best[inside]])


class Encoder:
    """Encodes batches of texts: the lexicon knows most chunks; of the others, words are looked up and else merged."""

    def __init__(self, tokenizer: Tokenizer, compiled: bytes) -> None:
        self.merges, self.split, self.lexicon = Merges(tokenizer), tokenizer.splitter(), Lexicon(compiled)
        self.tokens = pa.array(tokenizer.tokens, pa.string())

    def ids_of(self, distinct: pa.Array, whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks, or of words if ``whole``, one after another, and their numbers."""
        lexicon, at = self.lexicon, self.lexicon.places(distinct)
        known, other = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        lengths = np.zeros(len(at), np.int64)
        first = lexicon.starts[at[known]]
        lengths[known] = lexicon.starts[at[known] + 1] - first
        unseen = distinct.take(pa.array(other))
        merged, lengths[other] = self.merges(unseen) if whole else self.split_up(unseen)
        ids, begins = np.empty(lengths.sum(), np.int32), np.cumsum(lengths) - lengths
        ids[spread(begins[known], lengths[known])] = lexicon.ids[spread(first, lengths[known])]
        ids[spread(begins[other], lengths[other])] = merged
        return ids, lengths

    def split_up(self, unseen: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that the lexicon does not have, by their words."""
        # Most chunks are split together, a line each; special tokens and letters of two units are looked at one by one.
        rare = pc.match_substring_regex(unseen, r"<\||[\x{10000}-\x{10FFFF}]").to_numpy(zero_copy_only=False)
        lines = self.split("".join([c + "\n" for c in unseen.filter(pa.array(~rare)).to_pylist()]), True)
        alone = [[*self.split(c), "\n"] for c in unseen.filter(pa.array(rare)).to_pylist()]
        words = pa.array(chain(lines, *alone), pa.string()).dictionary_encode()
        ended = pc.equal(words.dictionary, "\n")
        at, is_end = words.indices.to_numpy(), ended.to_numpy(zero_copy_only=False)
        ids, lengths = self.ids_of(pc.if_else(ended, "", words.dictionary), True)
        # Each chunk ends with a line end, which has no ids.
        number = np.diff(np.cumsum(lengths[at])[is_end[at]], prepend=0)
        order = np.concatenate((np.flatnonzero(~rare), np.flatnonzero(rare)))
        own, begin = np.zeros((2, len(unseen)), np.int64)
        own[order], begin[order] = number, np.cumsum(number) - number
        flat = ids[spread((np.cumsum(lengths) - lengths)[at], lengths[at])]
        return flat[spread(begin, own)], own

    def encode(self, texts: pa.Array) -> tuple[pa.ListArray, pa.Array]:
        """Ids and decoded text of each text."""
        lists = chunks(texts)
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        offsets = offsets - offsets[0]
        ids, lengths = self.ids_of(coded.dictionary)
        begins = np.concatenate(([0], np.cumsum(lengths)))
        # What each distinct chunk decodes to is put together once.
        of_chunk = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(ids))
        decoded = pc.binary_join(pa.ListArray.from_arrays(of_chunk.offsets, self.tokens.take(of_chunk.values)), " ")
        at = coded.indices.to_numpy()
        own = lengths[at]
        ends = np.concatenate(([0], np.cumsum(own)))[offsets]
        all_ids = pa.array(ids[spread(begins[at], own)])
        # Chunks of nothing but rarer white space have no ids and take no part.
        some = own > 0
        places = np.concatenate(([0], np.cumsum(some)))[offsets]
        text = pa.ListArray.from_arrays(pa.array(places, pa.int32()), decoded.take(pa.array(at[some])))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), all_ids), pc.binary_join(text, " ")


def encode(docs: DataFrame, tokenizer: Tokenizer, lexicon: bytes, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``ids array<int>`` of each text and ``decoded``, the text those ids give back.

    A null text is an empty one and has no ids. Special tokens in a text keep their own ids. Decoded text is the tokens
    joined by a space, as a vocabulary without a decoder gives it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer, lexicon))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for part in pieces(batch):
                ids, decoded = encoder.encode(part.column(part.num_columns - 1))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, decoded], names=[*keep, "ids", "decoded"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], ids, T.StructField("decoded", T.StringType())]))


def lexicon_of(tokenizer: Tokenizer, found: list[str]) -> bytes:
    """The compiled lexicon of chunks with the ids of their words."""
    split, merged = tokenizer.splitter(), {}
    for word in set(chain.from_iterable(map(split, found))):
        merged[word] = tokenizer.merge(word)
    return compile_lexicon({c: tuple(chain.from_iterable(merged[w] for w in split(c))) for c in found})


def tokenize(docs: DataFrame, path: str, keep: list[str], words: int = WORDS) -> DataFrame:
    """:func:`encode` with a lexicon of the texts' own frequent chunks."""
    tokenizer = Tokenizer(path)
    return encode(docs, tokenizer, lexicon_of(tokenizer, frequent_words(docs, words)), keep)


def token_digests(encoded: DataFrame, keep: list[str]) -> DataFrame:
    """Number of tokens and SHA-256 of ids and decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded.select(
        *keep, F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
