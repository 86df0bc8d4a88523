"""Messages by key, with a language's own words first."""

from __future__ import annotations


def message(catalogue: dict[str, dict[str, str]], key: str, lang: str, fallback: str = "en", **values: object) -> str:
    """The text of a key in a language, else in the fallback, else the key itself; what it leaves open stays as it is."""
    text = catalogue.get(lang, {}).get(key) or catalogue.get(fallback, {}).get(key) or key
    try:
        return text.format(**values)
    except (KeyError, IndexError, ValueError):
        return text
