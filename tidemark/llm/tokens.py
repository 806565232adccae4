"""Loading public tokenizers in tasks, and splitting texts into pre-tokens as they do.

Texts made of common Latin characters are split by the tokenizer's own pattern here; all other texts go
through the library itself, whose Unicode tables then decide.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np

#: Outside this set the library splits: control characters and letters beyond Latin.
UNCOMMON = re.compile(r"[^\t-\r -~\u00a1-\u024f]")
#: The letters and numbers inside it, and the two public pre-token patterns for it.
LETTER, NUMBER = r"A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r"0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SUFFIX = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_PATTERN = re.compile(rf" ?[{LETTER}]+|{SUFFIX}| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")
WORD_PATTERN = re.compile(rf"[{LETTER}]+|{SUFFIX}|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")
#: Elsewhere a full stop or comma starts a pre-token of that pattern.
STOP_IN_SYMBOLS = re.compile(rf"[^\s{LETTER}{NUMBER}][.,]")
#: The character that byte-level vocabularies write for each byte; blanks are left as they are.
_SHOWN = [0x20, *range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTERS = np.arange(0x100, dtype="<u2")
BYTE_LETTERS[np.setdiff1d(np.arange(0x100), _SHOWN)] = [0x100 + i + (i > 31) for i in range(0x100 - len(_SHOWN))]


def load(path: str):
    """The tokenizer of a file, one thread, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_splitter(tokenizer) -> tuple[Callable[[str], list[str]], dict[str, int]]:
    """A function that cuts a text at its special strings (kept, at odd places), and their ids."""
    ids = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    if not ids:
        return lambda text: [text], ids
    at = re.compile("(" + "|".join(map(re.escape, sorted(ids, key=len, reverse=True))) + ")")
    return lambda text: at.split(text) if "<" in text or not all(k.startswith("<") for k in ids) else [text], ids


def byte_pretokens(tokenizer, text: str) -> list[str]:
    """Pre-tokens of a text without special strings, for a byte-level vocabulary."""
    if not UNCOMMON.search(text):
        return BYTE_PATTERN.findall(text)
    return [text[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
