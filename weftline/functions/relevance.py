"""Words of tasks and links, and how well a link fits a task."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .url import url_words
from .udfs import arrow

#: Words that say nothing of a topic.
STOP_WORDS = frozenset(
    # English
    "the a an and or of for to in on with from by as at is are be this that these those all any it its your you we our into "
    # Italian
    "di la il lo le gli un una uno e o per con da del della dei degli delle al alla allo ai agli alle che come su nel nella "
    "questo questa tutti tutte suo sua "
    # asking
    "extract estrai estrarre get find fetch scrape use usare using give list crawl collect gather complete completa completo "
    "completi full whole entire everything tutto tutta "
    # URLs
    "www http https com org net html htm php aspx index en us".split()
)
_CAMEL = regex.compile(r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_CJK = r"\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}"
_SCRIPTS = regex.compile(rf"([{_CJK}]+)|[^{_CJK}]+")


def tokenize(text: str | None) -> list[str]:
    """Lower-case words without accents, camelCase taken apart; runs of CJK letters as pairs of letters."""
    folded = unicodedata.normalize("NFKD", _CAMEL.sub(" ", text or ""))
    folded = "".join(c for c in folded if unicodedata.category(c)[0] != "M").lower()
    out = []
    for word in _WORD.findall(folded):
        for m in _SCRIPTS.finditer(word):
            run = m[0]
            if m[1]:
                out += [run] if len(run) == 1 else [run[i : i + 2] for i in range(len(run) - 1)]
            elif len(run) >= 2 and not re.fullmatch("[0-9]+", run) and run not in STOP_WORDS:
                out.append(run)
    return out


def task_terms(task: str | None) -> list[str]:
    return list(dict.fromkeys(tokenize(task)))


@arrow("array<string>")
def _tokens(text: pd.Series) -> pd.Series:
    return text.map(tokenize, na_action=None)


@arrow("array<string>")
def _link_tokens(href: pd.Series, label: pd.Series, context: pd.Series) -> pd.Series:
    rows = zip(href, label, context, strict=True)
    return pd.Series([list(dict.fromkeys([*tokenize(url_words(h or "")), *tokenize(a), *tokenize(c)])) for h, a, c in rows])


def tokens(text: Column) -> Column:
    return _tokens(text)


def link_tokens(href: Column, label: Column, context: Column) -> Column:
    return _link_tokens(href, label, context)


def term_hit(term: Column, token: Column) -> Column:
    """Equal, or one begins the other and both have four letters at least."""
    long = (F.length(term) >= 4) & (F.length(token) >= 4)
    return (term == token) | (long & (term.startswith(token) | token.startswith(term)))


def matched_terms(terms: list[str], own: Column) -> Column:
    n = F.lit(0)
    for t in terms:
        n = n + F.exists(own, _hits(t)).cast("int")
    return n


def _hits(term: str):
    return lambda token: term_hit(F.lit(term), token)


def link_score(terms: list[str], own: Column) -> Column:
    """0, 0.5 or 1 for none, one or more of the terms; 1 if the task has no terms."""
    return F.least(F.lit(1.0), matched_terms(terms, own) / 2) if terms else F.lit(1.0)


def link_text(label: Column, context: Column, href: Column) -> Column:
    """What a link is embedded as: label, heading, and its path in words."""
    from .url import path_of

    path = F.trim(F.regexp_replace(F.try_url_decode(path_of(href)), "[/_-]+", " "))
    blank = lambda c: F.when(c == "", None).otherwise(c)
    return F.substring(F.concat_ws(" — ", blank(label), blank(context), blank(path)), 1, 300)
