"""Benchmark decontamination by canonical templates.

Every text becomes a row of template tokens: numbers, names and units turn into
typed placeholders, other words into lower case without punctuation at their
ends. A name is a capitalised word that does not open a sentence. Windows of
``WINDOW`` tokens with ``LITERALS`` or more plain words are hashed; an item
shorter than that is one window of its own length. Windows of fewer plain words,
as of short or number-heavy items, say too little as templates: they are matched
by what they hold, value for value. An item of one or two tokens is matched only
where it is the whole document.

A document's windows pass a bitmap of ``2^BITS`` bits of the benchmark's hashes (a
fixed size, so it is broadcast) and then a hash join on the hash and the window's
template, in which placeholders are numbered by their values: equal values stay
equal, different ones different. So a question whose numbers or names were
exchanged still matches, one whose values do not correspond does not. Windows in
one alignment of document and item must also agree with each other; where they
do not, only windows without placeholders count.

Items whose whole texts have one template are a class: whether a document's values
agree with one of them is the same for all, so the lowest item stands for the class
in the join, and the list of items is put in after matching. Items that only share
a passage are of different classes and are judged each by its own values.

``n_windows`` counts windows of the document, each once, however many items hold it.
``reparameterised`` is true where the values found differ from those of any item in
``items``.

Defined results: one row per input row, repeated ones too; null and empty texts
and null benchmark texts match nothing; an empty benchmark marks nothing; an
empty table gives no rows. A text however long is one row in a task, and its
windows are made in one pass; columns beyond key, doc_id and text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.labelled import tidy
from loomgraph.shared import drop, store

WINDOW = 8
LITERALS = 4
#: An item of fewer tokens must be the whole document.
SHORT = 3
BITS = 24
#: Whole texts that lie in a Python worker at once.
BATCH_ROWS = 1000
CACHE = 400_000
#: Units of measure and spelled numbers that become placeholders.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces ton tons "
    "ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degree degrees mph kph watt watts volt volts joule joules newton newtons hz khz mhz".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(?:%|[a-zA-Z]{1,3})?")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¿¡«»“”‘’…–—"
_END, _CAPITAL, _SLOT = 1, 2, 4
_KINDS = {name: (xxhash.xxh64_intdigest(f"\0{name}") >> 4) << 3 for name in ("NUM", "UNIT", "NAME")}
_PRIME = 0x9E3779B97F4A7C15
HITS = "uid string, doc_id string, pos int, h long, template string, slots array<string>"


class Templates:
    """Tokens to codes: a 60-bit hash of the canonical token over three flags."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def _code(self, token: str) -> int:
        core = token.strip(_EDGES)
        end = _END if token.rstrip("\"'”’)]»")[-1:] in (".", "!", "?", ":") else 0
        low = core.lower()
        if _NUMBER.fullmatch(core) or low in NUMBERS:
            return _KINDS["NUM"] | _SLOT | end
        if low in UNITS:
            return _KINDS["UNIT"] | _SLOT | end
        capital = _CAPITAL if core[:1].isupper() and core[1:].islower() else 0
        return (xxhash.xxh64_intdigest((low or token).encode("utf-8", "replace")) >> 4) << 3 | capital | end

    def __call__(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Canonical hashes, which tokens are placeholders, and hashes of the words themselves."""
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = [seen.get(t) for t in tokens]
        if None in out:
            for i, code in enumerate(out):
                if code is None:
                    out[i] = seen[tokens[i]] = self._code(tokens[i])
        codes = np.array(out, np.int64)
        opens = np.concatenate([[True], (codes[:-1] & _END) > 0])[: len(codes)]
        name = ((codes & _CAPITAL) > 0) & ~opens
        slot = ((codes & _SLOT) > 0) | name
        words = codes >> 3
        for i in np.flatnonzero(codes & _SLOT).tolist():
            words[i] = xxhash.xxh64_intdigest(tokens[i].strip(_EDGES).lower().encode("utf-8", "replace")) >> 4
        return np.where(name, _KINDS["NAME"] >> 3, codes >> 3).astype(np.uint64), slot, words.astype(np.uint64)


def window_hashes(codes: np.ndarray, slot: np.ndarray, words: np.ndarray, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start positions and hashes of the windows, and which have too few plain words, so that the words themselves are hashed."""
    n = len(codes) - width + 1
    if n < 1 or width < SHORT and n > 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    running = np.concatenate([[0], np.cumsum(~slot)])
    bare = running[width:] - running[:-width] < literals
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h = h * np.uint64(_PRIME) + codes[j : j + n]
    at = np.flatnonzero(bare)
    if len(at):
        own = np.full(len(at), width, np.uint64)
        for j in range(width):
            own = own * np.uint64(_PRIME) + words[at + j]
        h[at] = ~own
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.arange(n), h, bare


def describe(tokens: list[str], slot: np.ndarray, codes: np.ndarray, at: int, width: int, bare: bool = False) -> tuple[str, list[str]]:
    """A window's template with numbered placeholders, and the placeholders' kinds and values in order; of a bare one its words."""
    if bare:
        return "= " + " ".join(t.strip(_EDGES).lower() or t for t in tokens[at : at + width]), []
    out, values, number = [], [], {}
    kinds = {v >> 3: k for k, v in _KINDS.items()}
    for i in range(at, at + width):
        core = tokens[i].strip(_EDGES).lower()
        if slot[i]:
            kind = kinds[int(codes[i])]
            values.append(f"{kind} {core}")
            out.append(f"<{kind}{number.setdefault((kind, core), len(number))}>")
        else:
            out.append(core or tokens[i])
    return " ".join(out), values


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """item_id, class, variant, ipos, h, width, template, islots; one row for each window of each item. A variant is one text of a class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        templates = Templates()
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                tokens = text.split()
                w = min(width, len(tokens))
                if not w:
                    continue
                codes, slot, words = templates(tokens)
                whole, values = describe(tokens, slot, codes, 0, len(tokens))
                kind, variant = (xxhash.xxh128_hexdigest(x.encode("utf-8", "replace")) for x in (whole, "\n".join(values)))
                for at, h, bare in zip(*window_hashes(codes, slot, words, w, literals)):
                    own = f"{kind} {variant}" if bare else kind  # words stand for the items that hold them alone
                    rows.append((item, own, variant, int(at), int(h.view(np.int64)), w, *describe(tokens, slot, codes, int(at), w, bare)))
            yield pd.DataFrame(rows, columns=["item_id", "class", "variant", "ipos", "h", "width", "template", "islots"])

    rows = benchmark.filter(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.mapInPandas(run, "item_id long, class string, variant string, ipos int, h long, width int, template string, islots array<string>")


def class_windows(made: DataFrame) -> DataFrame:
    """class, h, template, ipos, width, islots of its lowest item, and whether its items differ in ``islots``."""
    best = made.groupBy("class", "h", "template", "ipos", "width").agg(F.min(F.struct("item_id", "variant", "islots")).alias("b"), (F.min("islots") != F.max("islots")).alias("mixed"))
    return best.select("class", "h", "template", "ipos", "width", "b.islots", "mixed")


def hits(docs: DataFrame, windows: DataFrame, width: int = WINDOW, literals: int = LITERALS, key: str | None = None) -> DataFrame:
    """``HITS``: the windows of documents that pass the bitmap, and for every document one row whose pos is null; uid is ``key`` or a number of its own."""
    spark = docs.sparkSession
    low = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1))
    words = windows.select(F.shiftright(low, 5).alias("word"), F.expr(f"shiftleft(1L, cast(h & 31L as int))").alias("bit"))
    bits = np.zeros(1 << (BITS - 5), np.uint32)  # at most 2^19 rows come back, whatever the benchmark
    for word, value in words.groupBy("word").agg(F.expr("bit_or(bit)")).collect():
        bits[word] = value
    shorter = [r[0] for r in windows.select("width").filter(F.col("width") < width).distinct().collect()]
    shared = spark.sparkContext.broadcast((bits, sorted(shorter)))

    @tidy
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bits, shorter = shared.value
        uid, templates = TaskContext.get().partitionId() << 33, Templates()
        for batch in batches:
            rows = []
            for own, doc, text in zip(batch["own"], batch["doc_id"], batch["text"]):
                name = own if key else str(uid)
                rows.append((name, doc, None, None, None, None))
                tokens = text.split()
                codes, slot, words = templates(tokens)
                for w in (width, *shorter):
                    at, h, bare = window_hashes(codes, slot, words, w, literals)
                    low = (h & np.uint64((1 << BITS) - 1)).astype(np.int64)
                    near = np.flatnonzero(bits[low >> 5] >> (low & 31).astype(np.uint32) & np.uint32(1))
                    for k in near:
                        rows.append((name, doc, int(at[k]), int(h[k].view(np.int64)), *describe(tokens, slot, codes, int(at[k]), w, bare[k])))
                uid += 1
            uids, ids, at, h, template, slots = zip(*rows) if rows else ((),) * 6
            yield pd.DataFrame({"uid": uids, "doc_id": ids, "pos": pd.array(at, dtype="Int32"), "h": pd.array(h, dtype="Int64"), "template": template, "slots": slots})

    own = (_as_text(docs, key) if key else F.lit("")).alias("own")
    return docs.select(own, F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, HITS)


def _as_text(docs: DataFrame, key: str):
    return F.hex(key) if docs.schema[key].dataType.simpleString() == "binary" else F.col(key).cast("string")


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, literals: int = LITERALS, key: str | None = None) -> DataFrame:
    """doc_id, contaminated, n_windows, n_items, reparameterised, items; one row per input row, with ``key`` first if it names a column that rows of different texts do not share."""
    made = store(benchmark_windows(benchmark, width, literals), "templates")
    classes = made.groupBy("class").agg(F.collect_set("item_id").alias("members"))
    windows = store(class_windows(made), "windows")
    found = store(hits(docs, windows, width, literals, key), "hits", BATCH_ROWS)
    every = found.filter("pos IS NULL").select("uid", "doc_id")
    joined = found.filter("pos IS NOT NULL").join(windows, ["h", "template"])
    place = F.struct("pos", "width")
    lined = joined.groupBy("uid", "class", (F.col("pos") - F.col("ipos")).alias("offset")).agg(
        F.collect_set(place).alias("windows"),
        F.collect_set(F.when(F.size("slots") == 0, place)).alias("plain"),
        F.array_distinct(F.flatten(F.collect_list(F.arrays_zip("islots", "slots")))).alias("pairs"),
        F.max("mixed").alias("mixed"),
    )
    several = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side])))
    agree = (several("islots") == F.size("pairs")) & (several("slots") == F.size("pairs"))
    changed = agree & (F.col("mixed") | F.exists("pairs", lambda p: p["islots"] != p["slots"]))
    counted = lined.select("uid", "class", F.when(agree, F.col("windows")).otherwise(F.col("plain")).alias("windows"), changed.alias("changed")).filter(F.size("windows") > 0)
    union = lambda column: F.array_distinct(F.flatten(F.collect_list(column)))
    marks = counted.join(classes, "class").groupBy("uid").agg(F.size(union("windows")).cast("long").alias("n_windows"), F.sort_array(union("members")).alias("items"), F.max("changed").alias("reparameterised"))
    out = every.join(marks, "uid", "left")
    kind = docs.schema[key].dataType.simpleString() if key else ""
    return out.select(
        *([(F.unhex("uid") if kind == "binary" else F.col("uid").cast(kind)).alias(key)] if key else []),
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.col("n_windows").isNotNull().alias("contaminated"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("reparameterised", F.lit(False)).alias("reparameterised"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
    )
