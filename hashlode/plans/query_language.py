"""Query strings to predicate trees, on the driver.

Terms are joined by AND; ``"phrases"``, AND, OR, NOT, + and -, parentheses, ``field:`` and ``^boost`` are known. A
word that holds several tokens is a phrase. What can't be parsed raises QueryError, and the caller parses again what
the sanitiser leaves, at last taking all words as required terms (T8).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from hashlode.functions.text import sanitize_text, text_tokens

FIELDS = ("title", "info_hash")
_LEXEME = re.compile(r'\s*(?:(?P<par>[()])|(?P<sign>[+-])(?=\S)|(?:(?P<field>[A-Za-z_]+):)?(?:"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?(?P<star>\*)?|(?P<word>[^\s()"]+)))')


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Words:
    """Neighbouring tokens; one token is a term."""

    tokens: tuple[str, ...]
    field: str | None = None
    boost: float = 1.0
    slop: int = 0
    prefix: bool = False


@dataclass(frozen=True)
class Combined:
    """must: all of them; should: any, if there is no must; must_not: none."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


@dataclass(frozen=True)
class Everything:
    pass


def parse(query: str):
    lexemes, at = [], 0
    query = query.rstrip()
    while at < len(query):
        m = _LEXEME.match(query, at)
        if not m:
            raise QueryError(f"unexpected {query[at:]!r}")
        lexemes.append(m)
        at = m.end()
    tree, rest = _clauses(lexemes, 0)
    if rest != len(lexemes):
        raise QueryError("unbalanced )")
    return tree


def _clauses(lexemes: list, at: int):
    """OR over AND groups, up to a closing parenthesis."""
    groups: list[tuple[list, list]] = [([], [])]
    sign, pending = None, False
    while at < len(lexemes):
        m = lexemes[at]
        word = m["word"] if not m["field"] and m["phrase"] is None else None
        if m["par"] == ")":
            break
        if word in ("AND", "OR"):
            if not any(groups[-1]) or sign or pending:
                raise QueryError(f"{word} without a left side")
            if word == "OR":
                groups.append(([], []))
            pending = True
            at += 1
            continue
        if word == "NOT" or m["sign"]:
            sign = "-" if word == "NOT" else m["sign"]
            at += 1
            continue
        if m["par"] == "(":
            node, at = _clauses(lexemes, at + 1)
            if at >= len(lexemes) or lexemes[at]["par"] != ")":
                raise QueryError("unbalanced (")
        else:
            node = _leaf(m)
        at += 1
        if node is not None:
            groups[-1][1 if sign == "-" else 0].append(node)
        sign, pending = None, False
    if sign or pending:
        raise QueryError("an operator ends the query")
    made = [_group(must, must_not) for must, must_not in groups]
    made = [g for g in made if g is not None]
    if not made:
        return None, at
    return (made[0] if len(made) == 1 else Combined(should=tuple(made))), at


def _group(must: list, must_not: list):
    if not must and not must_not:
        return None
    return must[0] if len(must) == 1 and not must_not else Combined(must=tuple(must), must_not=tuple(must_not))


def _leaf(m):
    field = m["field"]
    if field and field not in FIELDS:
        raise QueryError(f"{field} is not searchable")
    text, boost = m["phrase"], 1.0
    if text is None:
        text = m["word"]
        if text == "*" and not field:
            return Everything()
        found = re.fullmatch(r"(.*)\^(\d+(?:\.\d+)?)", text)
        if found:
            text, boost = found[1], float(found[2])
        if re.search(r"[\^~*?\[\]{}\\:!]", text):
            raise QueryError(f"unexpected sign in {text!r}")
    if field == "info_hash":
        return Words((text.strip().lower(),), field, boost)
    found = tuple(text_tokens(text))
    return Words(found, field, boost, int(m["slop"] or 0), bool(m["star"])) if found else None


def parse_leniently(query: str):
    """The three tiers; None if nothing is left to search."""
    try:
        return parse(query)
    except QueryError:
        pass
    try:
        return parse(sanitize_text(query))
    except QueryError:
        words = text_tokens(sanitize_text(query))
        return Combined(must=tuple(Words((w,), "title") for w in words)) if words else None


def terms(node) -> list[str]:
    """Title tokens that score, without repeats."""
    if isinstance(node, Words):
        return list(dict.fromkeys(node.tokens)) if node.field != "info_hash" else []
    if isinstance(node, Combined):
        return list(dict.fromkeys(t for x in (*node.must, *node.should) for t in terms(x)))
    return []
