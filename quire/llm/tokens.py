"""Tokens as the problems define them: a maximal run of letters or digits in lower case; every Han or kana character is one."""

from __future__ import annotations

import re
import unicodedata

HAN_KANA = "぀-ヿ㐀-䶿一-鿿"
TOKEN = re.compile(f"[{HAN_KANA}]|[^\\W_{HAN_KANA}]+")


def tokens(text: str) -> list[str]:
    """Tokens of the composed, lower-case text."""
    return TOKEN.findall(unicodedata.normalize("NFC", text).lower())
