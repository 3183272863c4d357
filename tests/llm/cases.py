"""Small tables with every odd case, and plain Python counterparts of shared rules."""

from __future__ import annotations

import random
import re

from lupafiscal.llm.queries import tokenizer_path

PATH = tokenizer_path()
UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}
# Columns that clash with names the operators use inside.
EXTRA = (
    "t string, d long, k0 string, c long, n long, row string, h long, size int, bands string, "
    "n_words long, spans string, items string, kept string, line string, removed string"
)
SCHEMA = f"doc_id long, text string, {EXTRA}"


def documents(spark, rows):
    """A table of (doc_id, text) with clashing extra columns, in three partitions."""
    filler = ("x", 7, "k", 1, 2, "r", 3, 4, "b", 5, "s", "i", "k", "l", "m")
    frame = spark.createDataFrame([(d, t, *filler) for d, t in rows], SCHEMA)
    return frame.repartition(3) if rows else frame


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def prose(seed, n, vocabulary=400):
    """n words from a small vocabulary, deterministic."""
    rng = random.Random(seed)
    names = [f"w{i}" + "aeiou"[i % 5] * (i % 3) for i in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(n))


def odd_texts():
    return [
        None, "", "   ", "\n\n", "one", "two words", "Ünïcödé wörds — 中文 字符 and emoji 😀😀", "a\u0000b control\x1fchars",
        "the same four words", "the same four words", "x" * 5000, "it's we'll 'tis '' don't!!'s 12'd",
        "<|endoftext|> inside", "İstanbul and\u0085blanks",
    ]
