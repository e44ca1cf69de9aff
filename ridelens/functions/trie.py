"""Counting many phrases in one pass: a trie compiled to one regular expression.

At every place of the text a look-ahead takes the longest phrase that starts there,
so matches of different phrases may overlap. Whatever other phrase starts at the
place is a prefix of that longest one. The number of places a phrase starts at is
its number of non-overlapping occurrences, unless two of them overlap ("abab" in
"ababab"). A phrase can do so in a few ways only, one per prefix that is also its
end; these doubled texts (:func:`doubles`) are put into the trie too, so that the
rare text that holds one shows it.
"""

from __future__ import annotations

from collections.abc import Sequence

from ridelens.functions.text import literal_pattern


def doubles(phrase: str) -> list[str]:
    """The texts of two occurrences of the phrase that overlap."""
    return [phrase + phrase[n:] for n in range(1, len(phrase)) if phrase.endswith(phrase[:n])]


def _insert(trie: dict, phrase: str) -> None:
    for ch in phrase:
        trie = trie.setdefault(ch, {})
    trie[""] = {}


def _compiled(trie: dict) -> str:
    """Pattern of what may follow a node; greedy, so the longest phrase wins."""
    branches = [literal_pattern(ch) + _compiled(below) for ch, below in trie.items() if ch]
    if not branches:
        return ""
    body = branches[0] if len(branches) == 1 and "" not in trie else "(?:" + "|".join(branches) + ")"
    return body + ("?" if "" in trie else "")


def trie_pattern(phrases: Sequence[str]) -> str:
    """One pattern whose group 1 is, at every place of a text, the longest of the phrases
    that starts there."""
    if not phrases or "" in phrases:
        raise ValueError("phrases must be given and not empty")
    trie: dict = {}
    for phrase in phrases:
        _insert(trie, phrase)
    first = "".join("\\" + ch if ch in "\\]^-[&" else ch for ch in trie)
    return f"(?=[{first}])(?=({_compiled(trie)}))"
