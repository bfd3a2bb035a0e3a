"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton reads tokens. It accepts a token sequence exactly if it is what the merges make of its text.
It starts as one state with an arc for every base symbol; each merge ``u v -> uv``, in the order of the merge
list, is one gadget: every state with an arc ``u`` whose target has an arc ``v`` gets an arc ``uv`` to where
``u v`` led, and the arcs ``u`` are led to a copy of their target that lacks ``v``. All arcs of one token lead to
one state, so the table is a target per token and, per state, the arcs that are missing. Tokens are
numbered so that an arc and those that later merges would have built on it are neighbours: what a gadget takes from a
state is one range of numbers, and a row of the table is a sorted list of ranges.

Every prefix of a word has one accepted segmentation, hence one last token. Encoding goes through a word
position by position: of the tokens that end there, the one that has an arc from the state of the prefix
before it is the last token. All distinct words of a step are walked side by side. Words longer
than a stretch are walked in stretches at once, each from some symbols before its start; where the last
tokens on the seam differ from those of the stretch before, the stretch is walked again from there.

Decoding emits the labels of the arcs: token strings, one space between two.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargoledger.llm.common import CODES, WORD_SPACE, run_hashes, slices, text_buffer, words

SYMBOLS = 512  # byte symbols, and byte symbols that end a word
END = 256
# Longer words are walked in stretches of so many symbols, from so many symbols before them.
STRETCH = 1024
WARM_UP = 256
# Symbols whose lattice is in memory at once, and bytes of text of one step.
STEP_SYMBOLS = 1 << 19
STEP_BYTES = 4 << 20
# Distinct chunks that a Python worker remembers at most, and characters that are normalised as one text.
REMEMBERED = 1_000_000
JOINED_CHARS = 1 << 18


@dataclass
class Automaton:
    """The compiled table; its size depends on the vocabulary only."""

    symbol_ids: np.ndarray  # token id of every base symbol
    keys: np.ndarray  # prefix tree of the tokens: node * SYMBOLS + symbol, sorted
    children: np.ndarray  # node that each key leads to
    whole: np.ndarray  # token that ends at a node, or -1
    sizes: np.ndarray  # symbols of each token
    target: np.ndarray  # state after each token
    place: np.ndarray  # number of each token's arc
    gap_starts: np.ndarray  # state * n + first number of a range of missing arcs, sorted
    gap_ends: np.ndarray  # the range's last number

    def has_arc(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        place = self.place[token]
        n = len(self.place)
        gap = np.searchsorted(self.gap_starts, state * n + place, side="right") - 1
        inside = (self.gap_starts[gap] // n == state) & (self.gap_ends[gap] >= place)
        return ~(inside & (gap >= 0))


def byte_alphabet() -> list[str]:
    """The characters that stand for the 256 bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def compile_merges(vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> Automaton:
    """Build the automaton by one gadget per merge, in order."""
    alphabet = byte_alphabet()
    symbol_names = alphabet + [c + suffix for c in alphabet]
    symbol_of = {name: i for i, name in enumerate(symbol_names)}
    n = max(vocabulary.values()) + 1
    target = [0] * n
    rows: list[dict[int, int]] = [{}]  # per state: token whose arc a gadget took, and the number of the gadget
    spelled: dict[int, tuple[int, ...]] = {vocabulary[name]: (symbol,) for name, symbol in symbol_of.items()}
    built_on: dict[int, list[tuple[int, int]]] = {}  # token: (merge number, token that begins with it)
    made_by: dict[int, tuple[int, int]] = {}  # token: (merge number, its left part)
    for number, (left, right) in enumerate(merges):
        u, v, uv = vocabulary[left], vocabulary[right], vocabulary[left + right]
        if u not in spelled or v not in spelled or uv in spelled:
            raise ValueError(f"merge {number} uses a token before it is built, or builds one again")
        spelled[uv] = spelled[u] + spelled[v]
        row, since, part = rows[target[u]], number, v
        while True:
            if row.get(part, since) < since:
                raise ValueError(f"merge {number} never applies")
            if part not in made_by:
                break
            since, part = made_by[part]
        target[uv] = target[v]
        rows.append({**row, v: number})
        target[u] = len(rows) - 1
        made_by[uv] = (number, u)
        built_on.setdefault(u, []).append((number, uv))
    # Numbers in post-order of "is built on", tokens of earlier merges first: a token comes right after the
    # ones built on it, and those of a merge or a later one are a range that ends with it.
    place, first = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = 0
    for root in (vocabulary[name] for name in symbol_names):
        stack = [(root, iter(built_on.get(root, ())))]
        first[root] = count
        while stack:
            token, rest = stack[-1]
            step = next(rest, None)
            if step is None:
                place[token] = count
                count += 1
                stack.pop()
            else:
                first[step[1]] = count
                stack.append((step[1], iter(built_on.get(step[1], ()))))
    starts_after = {token: ([m for m, _ in later], [int(first[t]) for _, t in later]) for token, later in built_on.items()}
    gaps = []
    for state in sorted({0, *target}):
        for token, number in rows[state].items():
            low = int(place[token])
            if token in starts_after:
                numbers, begins = starts_after[token]
                k = bisect_left(numbers, number)
                low = begins[k] if k < len(begins) else low
            gaps.append((state * n + low, int(place[token])))
    gap = np.array(sorted(gaps), dtype=np.int64).reshape(-1, 2)
    nodes: dict[tuple[int, int], int] = {}
    ends = {0: -1}
    for token, symbols in spelled.items():
        node = 0
        for symbol in symbols:
            node = nodes.setdefault((node, symbol), len(nodes) + 1)
        ends[node] = token
    keys = np.array([node * SYMBOLS + symbol for node, symbol in nodes], dtype=np.int64)
    order = np.argsort(keys)
    whole = np.full(len(nodes) + 1, -1, np.int64)
    whole[list(ends)] = list(ends.values())
    sizes = np.zeros(n, np.int64)
    sizes[list(spelled)] = [len(s) for s in spelled.values()]
    return Automaton(
        symbol_ids=np.array([vocabulary[name] for name in symbol_names]),
        keys=keys[order],
        children=np.array(list(nodes.values()), dtype=np.int64)[order],
        whole=whole,
        sizes=sizes,
        target=np.array(target, dtype=np.int64),
        place=place,
        gap_starts=gap[:, 0].copy(),
        gap_ends=gap[:, 1].copy(),
    )


def load(tokenizer_path: str) -> Automaton:
    """Compile the automaton of a tokenizer file with byte-level merges and a word-end suffix."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    model = tokenizer["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return compile_merges(model["vocab"], merges, model["end_of_word_suffix"] or "")


def arc_labels(tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all labels in the order of their ids, each followed by a space, and where each begins, with the end."""
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = json.load(file)
    names = {i: name for name, i in tokenizer["model"]["vocab"].items()}
    names.update({t["id"]: t["content"] for t in tokenizer["added_tokens"]})
    encoded = [f"{names.get(i, '')} ".encode() for i in range(max(names) + 1)]
    return np.frombuffer(b"".join(encoded), np.uint8), np.concatenate(([0], np.cumsum([len(e) for e in encoded])))


def lattice(automaton: Automaton, symbols: np.ndarray, run_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, token) of all tokens that occur in runs; ``run_ends`` has the end of every position's run."""
    at, node, length = np.arange(len(symbols)), np.zeros(len(symbols), np.int64), 0
    starts, ends, tokens = [], [], []
    while len(at):
        key = node * SYMBOLS + symbols[at + length]
        found = np.minimum(np.searchsorted(automaton.keys, key), len(automaton.keys) - 1)
        going = automaton.keys[found] == key
        at, node, length = at[going], automaton.children[found[going]], length + 1
        token = automaton.whole[node]
        hit = token >= 0
        starts.append(at[hit])
        ends.append(at[hit] + length)
        tokens.append(token[hit])
        going = at + length < run_ends[at]
        at, node = at[going], node[going]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *starts]), np.concatenate([none, *ends]), np.concatenate([none, *tokens])


def last_tokens(automaton: Automaton, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Last token of every prefix of every run; runs of ``sizes`` symbols follow one another in ``symbols``."""
    run_ends = np.cumsum(sizes)
    run_starts = run_ends - sizes
    start, end, token = lattice(automaton, symbols, np.repeat(run_ends, sizes))
    begin = np.repeat(run_starts, sizes)
    depth = end - begin[end - 1]
    order = np.argsort(depth, kind="stable")
    start, end, token = start[order], end[order], token[order]
    bounds = np.cumsum(np.bincount(depth, minlength=2))
    opens = start == begin[start]
    last = np.full(len(symbols), -1, np.int64)  # by the prefix's last position
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        state = np.where(opens[a:b], 0, automaton.target[last[start[a:b] - 1]])
        fits = automaton.has_arc(state, token[a:b])
        last[end[a:b][fits] - 1] = token[a:b][fits]
    return last


def walk_again(automaton: Automaton, symbols: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Last tokens after the first ``len(known)`` prefixes of one long word, of which ``known`` are the last ones known."""
    longest = int(automaton.sizes.max())
    back = min(len(known), longest)
    run = symbols[len(known) - back :]
    start, end, token = lattice(automaton, run, np.full(len(run), len(run)))
    order = np.argsort(end, kind="stable")
    last = [-1] * len(run)
    last[:back] = known[len(known) - back :].tolist()
    target = automaton.target
    for s, e, t in zip(start[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
        if e > back and (s > 0 or back == len(known)):
            state = target[last[s - 1]] if s else np.int64(0)
            if automaton.has_arc(np.array([state]), np.array([t]))[0]:
                last[e - 1] = t
    return np.array(last[back:], dtype=np.int64)


def stretches(size: int) -> Iterator[tuple[int, int, int]]:
    """(warm-up start, start, end) of the stretches of a word."""
    for start in range(0, size, STRETCH):
        yield max(0, start - WARM_UP), start, min(size, start + STRETCH)


def encode_long(automaton: Automaton, symbols: np.ndarray) -> np.ndarray:
    """Token ids of one word of any length."""
    longest = int(automaton.sizes.max())
    last = np.empty(len(symbols), np.int32)
    plan = list(stretches(len(symbols)))
    group = max(1, STEP_SYMBOLS // (STRETCH + WARM_UP))
    for k in range(0, len(plan), group):
        some = plan[k : k + group]
        runs = np.concatenate([symbols[a:c] for a, _, c in some])
        sizes = np.array([c - a for a, _, c in some])
        found, at = last_tokens(automaton, runs, sizes), 0
        for (a, b, c), size in zip(some, sizes.tolist(), strict=True):
            own = found[at : at + size]
            at += size
            seam = min(longest, b - a)
            if b and not np.array_equal(own[b - a - seam : b - a], last[b - seam : b]):
                last[b:c] = walk_again(automaton, symbols[max(0, b - longest) : c], last[max(0, b - longest) : b])
            else:
                last[b:c] = own[b - a :]
    path, sizes, position = [], automaton.sizes.tolist(), len(symbols)
    for top in range(len(symbols), 0, -STEP_SYMBOLS):
        low = max(0, top - STEP_SYMBOLS)
        part = last[low:top].tolist()
        while position > low:
            token = part[position - 1 - low]
            path.append(token)
            position -= sizes[token]
    return np.array(path[::-1], dtype=np.uint32)


def encode_words(automaton: Automaton, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of words that follow one another in ``symbols``, and their number per word."""
    ends = np.cumsum(sizes)
    counts = np.zeros(len(sizes), np.int64)
    long = sizes > STRETCH
    parts: list[np.ndarray] = []
    bounds = np.concatenate(([0], ends))
    for i, j in slices(bounds, STEP_SYMBOLS):
        if j - i == 1 and long[i]:
            parts.append(encode_long(automaton, symbols[bounds[i] : bounds[j]]))
            counts[i] = len(parts[-1])
            continue
        special = {k: encode_long(automaton, symbols[bounds[k] : bounds[k + 1]]) for k in (np.flatnonzero(long[i:j]) + i).tolist()}
        short = np.flatnonzero(~long[i:j]) + i
        size = sizes[short]
        run_ends = np.cumsum(size)
        at = np.repeat(bounds[short] - run_ends + size, size) + np.arange(int(size.sum()))
        last = last_tokens(automaton, symbols[at], size)
        active, position, steps = np.arange(len(short)), run_ends.copy(), []
        run_starts = run_ends - size
        while len(active):
            token = last[position - 1]
            steps.append((active, token))
            position = position - automaton.sizes[token]
            going = position > run_starts[active]
            active, position = active[going], position[going]
        for who, _ in steps:
            counts[short[who]] += 1
        for k, ids in special.items():
            counts[k] = len(ids)
        token_ends = np.cumsum(counts[i:j])
        out = np.zeros(int(token_ends[-1]) if j > i else 0, np.uint32)
        for step, (who, token) in enumerate(steps):
            out[token_ends[short[who] - i] - 1 - step] = token
        for k, ids in special.items():
            out[token_ends[k - i] - len(ids) : token_ends[k - i]] = ids
        parts.append(out)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), counts


class ChunkEncoder:
    """Token ids of the runs between ASCII white space, remembered by hash.

    Text is normalised and split into words by the tokenizer's own normaliser and pattern, neither of which
    looks across white space. Special tokens are found in the text as it is; what lies between is
    normalised by itself.
    """

    def __init__(self, automaton: Automaton, tokenizer_path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        self.automaton = automaton
        self.normalize, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.special}
        self.specials = specials
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None
        self.symbol = np.full(0x200, -1, np.int64)
        for b, c in enumerate(byte_alphabet()):
            self.symbol[ord(c)] = b
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.begins = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def normalized(self, texts: list[str]) -> list[str]:
        """Each text normalised; white space inside one becomes a space."""
        joined = self.normalize("\n".join(texts)).split(" ")
        return joined if len(joined) == len(texts) else [self.normalize(t) for t in texts]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in sequence and their number per chunk."""
        owner, texts, fixed = [], [], []
        for i, chunk in enumerate(chunks):
            marked = self.marks.split(chunk) if self.marks and self.marks.search(chunk) else (chunk,)
            for k, part in enumerate(marked):
                owner.append(i)
                texts.append("" if k % 2 else part)
                fixed.append(self.specials[part] if k % 2 else -1)
        known: dict[str, int] = {}
        word_of, entry_of = [], []
        first, size = 0, 0
        for last, text in enumerate(texts, start=1):
            size += len(text)
            if size < JOINED_CHARS and last < len(texts):
                continue
            parts = self.normalized(texts[first:last])
            ends = np.cumsum([len(p) + 1 for p in parts])
            found = self.split(" ".join(parts))
            word_of.append(np.array([known.setdefault(w, len(known)) for w, _ in found], dtype=np.int64))
            entry_of.append(first + np.searchsorted(ends, [a for _, (a, _) in found], side="right"))
            first, size = last, 0
        spelling = list(known)
        symbols = self.symbol[np.frombuffer("".join(spelling).encode("utf-16-le"), np.uint16)].astype(np.int16)
        lengths = np.array([len(w) for w in spelling], dtype=np.int64)
        symbols[np.cumsum(lengths) - 1] += END
        ids, counts = encode_words(self.automaton, symbols, lengths)
        begins = np.cumsum(counts) - counts
        word, entry = np.concatenate(word_of) if word_of else np.zeros(0, np.int64), np.concatenate(entry_of) if entry_of else np.zeros(0, np.int64)
        fixed, owner = np.array(fixed, dtype=np.int64), np.array(owner, dtype=np.int64)
        marks = np.flatnonzero(fixed >= 0)
        if len(marks):
            ids, begins = np.concatenate((ids, fixed[marks].astype(np.uint32))), np.concatenate((begins, len(ids) + np.arange(len(marks))))
            counts = np.concatenate((counts, np.ones(len(marks), np.int64)))
            word, entry = np.concatenate((word, len(spelling) + np.arange(len(marks)))), np.concatenate((entry, marks))
            order = np.argsort(entry, kind="stable")
            word, entry = word[order], entry[order]
        per_word = counts[word]
        ends = np.cumsum(per_word)
        out = ids[np.repeat(begins[word] - ends + per_word, per_word) + np.arange(int(per_word.sum()))]
        return out, np.bincount(owner[entry], weights=per_word, minlength=len(chunks)).astype(np.int64)

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks ``data[starts:ends]`` in sequence, and their number per chunk."""
        hashes, at, inverse = np.unique(run_hashes(data, starts, ends, CODES), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        new = self.hashes[place] != hashes if len(self.hashes) else np.ones(len(hashes), bool)
        if len(self.hashes) + new.sum() > REMEMBERED:
            self.clear()
            new[:] = True
        raw = data.tobytes()
        chunks = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
        ids, counts = self.encode_chunks(chunks)
        begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(counts) - counts))
        merged, sizes = np.concatenate((self.hashes, hashes[new])), np.concatenate((self.sizes, counts))
        order = np.argsort(merged, kind="stable")
        self.hashes, self.begins, self.sizes, self.ids = merged[order], begins[order], sizes[order], np.concatenate((self.ids, ids))
        known = np.searchsorted(self.hashes, hashes)[inverse]
        per_chunk = self.sizes[known]
        ends = np.cumsum(per_chunk)
        return self.ids[np.repeat(self.begins[known] - ends + per_chunk, per_chunk) + np.arange(int(per_chunk.sum()))], per_chunk


def parts_of(data: np.ndarray, limit: int = STEP_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of about ``limit`` bytes that end before white space; a run without any stays whole."""
    first = 0
    while first < len(data):
        last = min(first + limit, len(data))
        while last < len(data):
            found = np.flatnonzero(WORD_SPACE[data[last : last + limit]])
            last += int(found[0]) if len(found) else min(limit, len(data) - last)
            if len(found):
                break
        yield data[first:last]
        first = last


def encode_column(encoder: ChunkEncoder, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, offsets of the rows) for the rows of a column, some at a time."""
    data, offsets = text_buffer(column)
    for i, j in slices(offsets, STEP_BYTES):
        own = data[offsets[i] : offsets[j]]
        if j - i == 1 and len(own) > STEP_BYTES:
            found = [encoder.encode(p, *words(p, np.array([0, len(p)]))[:2])[0] for p in parts_of(own)]
            ids = np.concatenate(found)
            yield i, j, ids, np.array([0, len(ids)])
            continue
        starts, ends, row = words(own, offsets[i : j + 1] - offsets[i])
        ids, counts = encoder.encode(own, starts, ends)
        tokens = np.concatenate(([0], np.cumsum(counts)))
        yield i, j, ids, tokens[np.searchsorted(row, np.arange(j - i + 1))]


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    text_column: str = "text",
    carried: tuple[str, ...] = ("doc_id",),
    digests: bool = False,
) -> DataFrame:
    """``carried`` columns and ``ids`` of the whole text of every row; with ``digests`` also ``n_tokens`` and ``ids_sha256``.

    The digest is lowercase hex over the ids as little-endian unsigned 32-bit numbers. Special tokens that occur in a
    text are encoded as such; none is added. A null text counts as empty and has no ids; repeated rows come out as
    often as they occur, an empty table gives no rows, and columns that are not carried are not read. Long texts are
    encoded in parts that end before white space, a run without white space in stretches; a worker holds one text, its
    ids and one part's tables. The table of the automaton is broadcast; its size is that of the vocabulary.
    """
    rows = docs.select(F.struct(*[F.col(c) for c in carried]).alias("carried"), F.col(text_column).cast("string").alias("text"))
    automaton = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ChunkEncoder(automaton.value, tokenizer_path)
        for batch in batches:
            for i, j, ids, bounds in encode_column(encoder, batch.column("text")):
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.view(np.int32)))
                columns, names = [batch.column("carried").slice(i, j - i), lists], ["carried", "ids"]
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    digest = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    columns += [pa.array(np.diff(bounds)), pa.array(digest, pa.string())]
                    names += ["n_tokens", "ids_sha256"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = [rows.schema["carried"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if digests:
        fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType(fields)).select("carried.*", *[f.name for f in fields[1:]])


def decode(encoded: DataFrame, tokenizer_path: str, ids_column: str = "ids", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carried`` columns and ``text``: the labels of the ids' arcs, one space between two. Null ids give null text."""
    rows = encoded.select(F.struct(*[F.col(c) for c in carried]).alias("carried"), F.col(ids_column).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = arc_labels(tokenizer_path)
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.asarray(lists.offsets, dtype=np.int64)
            ids = np.asarray(lists.values, dtype=np.int64)
            missing = np.asarray(lists.is_null())
            for i, j in slices(bounds, STEP_BYTES // 8):
                own = ids[bounds[i] : bounds[j]]
                texts = _labels(*labels, own, bounds[i : j + 1] - bounds[i], missing[i:j])
                yield pa.RecordBatch.from_arrays([batch.column("carried").slice(i, j - i), texts], names=["carried", "text"])

    schema = T.StructType([rows.schema["carried"], T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).select("carried.*", "text")


def _labels(labels: np.ndarray, begins: np.ndarray, ids: np.ndarray, bounds: np.ndarray, missing: np.ndarray) -> pa.Array:
    """Texts of rows of ids; of a row's last label the space is left out."""
    width = np.diff(begins)
    pieces, sizes = [], np.zeros(len(bounds) - 1, np.int64)
    for first in range(0, len(ids), STEP_SYMBOLS):
        some = ids[first : first + STEP_SYMBOLS]
        size = width[some]
        ends = np.cumsum(size)
        pieces.append(labels[np.repeat(begins[some] - ends + size, size) + np.arange(int(ends[-1]))])
    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.uint8)
    ends = np.concatenate(([0], np.cumsum(width[ids])))[bounds]
    sizes = np.diff(ends)
    keep = np.ones(len(flat), bool)
    keep[ends[1:][sizes > 0] - 1] = False
    out = np.concatenate(([0], np.cumsum(np.maximum(sizes - 1, 0)))).astype(np.int32)
    mask = pa.py_buffer(np.packbits(~missing, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(sizes), [mask, pa.py_buffer(out), pa.py_buffer(flat[keep].tobytes())])
