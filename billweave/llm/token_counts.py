"""Token counts by byte-pair merging with a heap and a linked list.

A text is normalised and split into words as the tokenizer's file says. The symbols of a word form a linked
list; a heap holds the adjacent pairs by merge rank and place, and the lowest is merged again and again.
The count of a word is its symbols minus its merges: no identifiers are made. Equal words have equal
counts, so each task remembers those of recent words.

The merge ranks are read once on the driver from the file given and broadcast; their number is a property
of the tokenizer (48,894 here), not of the data. Rows stay where they are; nothing is shuffled.

Edge cases: a null text counts as empty: 0 bytes, 0 tokens. Long words are merged in O(n log n). Repeated
rows count alike. An empty table gives an empty table; a column named like a new one is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from billweave.llm.common import map_batches, texts

#: Remembered words per task; the memory is emptied when it is full, results don't depend on it.
MEMORY = 1_000_000
SHIFT = 20


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files: itself where it is
    printable, else the next one from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class MergeTable:
    """What a tokenizer file says, as far as counting needs it. Symbols are numbered; a pair's key is the
    first number shifted by ``SHIFT`` plus the second, its value the rank and the merged symbol's number."""

    numbers: dict[str, int]
    merges: dict[int, tuple[int, int]]
    word_end: str
    words: str
    specials: tuple[str, ...]


def read_table(path: str) -> MergeTable:
    """Read a tokenizers file of the kind: NFC, white space to a blank, lower case; words by a pattern;
    byte-level pairs with a word end. Anything else is refused rather than counted wrong."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps = spec["normalizer"]["normalizers"] if spec["normalizer"] else []
    split, level = spec["pre_tokenizer"]["pretokenizers"]
    model = spec["model"]
    if (
        [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"]
        or (steps[1]["pattern"], steps[1]["content"]) != ({"Regex": "\\s+"}, " ")
        or (split["type"], split["behavior"], split["invert"]) != ("Split", "Removed", True)
        or (level["type"], level["add_prefix_space"], level["use_regex"]) != ("ByteLevel", False, False)
        or (model["type"], model["unk_token"], model["continuing_subword_prefix"], model["dropout"], model["ignore_merges"]) != ("BPE", None, None, None, False)
        or any(x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] for x in spec["added_tokens"])
    ):
        raise ValueError(f"{path}: not a tokenizer of the kind that this operator counts")
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    missing = {a + b for a, b in pairs} - model["vocab"].keys()
    if missing:
        raise ValueError(f"{path}: merges make symbols that have no id")
    letters, end = byte_letters(), model["end_of_word_suffix"] or ""
    numbers: dict[str, int] = {}
    for symbol in [*letters, *(x + end for x in letters), *(x for a, b in pairs for x in (a, b, a + b))]:
        numbers.setdefault(symbol, len(numbers))
    merges: dict[int, tuple[int, int]] = {}
    for rank, (a, b) in enumerate(pairs):
        merges.setdefault(numbers[a] << SHIFT | numbers[b], (rank, numbers[a + b]))
    return MergeTable(numbers, merges, end, split["pattern"]["Regex"], tuple(x["content"] for x in spec["added_tokens"]))


def count_word(symbols: list[int], merges: dict[int, tuple[int, int]]) -> int:
    """Symbols left after merging the lowest-ranked adjacent pair, leftmost first, until none is left.

    ``waiting[i]`` is the rank of the pair that begins at ``i``, so an entry of the heap whose pair has
    changed meanwhile is known by its rank.
    """
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, heap, waiting = merges.get, [], [-1] * n
    for i in range(n - 1):
        if (m := get(symbols[i] << SHIFT | symbols[i + 1])) is not None:
            waiting[i] = m[0]
            heap.append(m[0] << 32 | i)
    heapify(heap)
    while heap:
        entry = heappop(heap)
        i = entry & 0xFFFFFFFF
        if waiting[i] != entry >> 32:
            continue
        j = after[i]
        symbols[i] = x = get(symbols[i] << SHIFT | symbols[j])[1]
        left -= 1
        waiting[j] = waiting[i] = -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (m := get(x << SHIFT | symbols[k])) is not None:
                waiting[i] = m[0]
                heappush(heap, m[0] << 32 | i)
        h = before[i]
        if h >= 0:
            if (m := get(symbols[h] << SHIFT | x)) is not None:
                waiting[h] = m[0]
                heappush(heap, m[0] << 32 | h)
            else:
                waiting[h] = -1
    return left


def counter(table: MergeTable) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    letters, merges = byte_letters(), table.merges
    inner = [table.numbers[x] for x in letters]
    last = [table.numbers[x + table.word_end] for x in letters]
    find = regex.compile(table.words).findall
    # An added token is cut out of the raw text, the longest at the leftmost place.
    special = regex.compile("|".join(regex.escape(s) for s in sorted(table.specials, key=len, reverse=True))) if table.specials else None
    runs: dict[str, int] = {}
    words: dict[str, int] = {}

    def word(w: str) -> int:
        raw = w.encode("utf-8")
        symbols = [inner[b] for b in raw]
        symbols[-1] = last[raw[-1]]
        if len(words) >= MEMORY:
            words.clear()
        words[w] = n = count_word(symbols, merges)
        return n

    def run(text: str) -> int:
        """Count a text without white space. No word reaches over white space, and neither does NFC."""
        own = text if text.isascii() else unicodedata.normalize("NFC", text)
        n = sum(words.get(w) or word(w) for w in find(lower(own)))
        if len(runs) >= MEMORY:
            runs.clear()
        runs[text] = n
        return n

    def plain(text: str) -> int:
        known, total = runs.get, 0
        for part in split_at_white_space(text):
            n = known(part)
            total += run(part) if n is None else n
        return total

    def count(text: str) -> int:
        if special is None or not any(s in text for s in table.specials):
            return plain(text)
        parts = special.split(text)
        return sum(map(plain, parts)) + len(parts) - 1

    return count


#: ``str.split`` also splits at these four, which the pattern does not count as white space.
SEPARATOR_CODES = regex.compile("[\x1c-\x1f]")


def split_at_white_space(text: str) -> list[str]:
    return regex.split(r"\s+", text) if SEPARATOR_CODES.search(text) else text.split()


def lower(text: str) -> str:
    """Lower case letter by letter: unlike ``str.lower``, a final sigma is a sigma like any other."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


def token_counts(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_table(tokenizer))
    made: dict[str, Callable[[str], int]] = {}

    def function(batch: pa.RecordBatch) -> list[pa.Array]:
        if "count" not in made:
            made["count"] = counter(shared.value)
        bodies = [t or "" for t in texts(batch, text)]
        tokens = [made["count"](t) for t in bodies]
        return [
            pa.array([len(t.encode("utf-8", "surrogatepass")) for t in bodies], pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array([n > limit for n in tokens], pa.bool_()),
        ]

    return map_batches(docs, [("n_bytes", "bigint"), ("n_tokens", "bigint"), ("over_limit", "boolean")], function)
