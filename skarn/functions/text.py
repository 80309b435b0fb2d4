"""Text functions: tokens, sentences, terms, names and estimates, as Column builders."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words that results depend on. Those with an apostrophe never match a token, as apostrophes
#: separate.
STOPWORDS = (
    "a about above after again against all am an and any are aren't as at be because been before being below between both but by can can't cannot "
    "could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has hasn't have haven't having he he'd "
    "he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in into is isn't it it's its itself let's "
    "me more most mustn't my myself no nor not of off on once only or other ought our ours ourselves out over own same shan't she she'd she'll "
    "she's should shouldn't so some such than that that's the their theirs them themselves then there there's these they they'd they'll they're they've "
    "this those through to too under until up very was wasn't we we'd we'll we're we've were weren't what what's when when's where where's which while "
    "who who's whom why why's with won't would wouldn't you you'd you'll you're you've your yours yourself yourselves"
).split()
#: File extensions that count as code.
CODE_EXTENSIONS = "ts tsx js jsx py rs go java c cpp h hpp html css json yaml yml".split()


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def words_apart(text: Column) -> Column:
    """Lower case; anything but a-z, 0-9, _ and - separates. The first or last may be empty."""
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\-]+")


def tokens(text: Column) -> Column:
    """The words of more than one character that are no stop words."""
    return F.filter(words_apart(text), lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS))


def query_terms(text: Column) -> Column:
    """Terms of a question: of more than two characters, stop words and repetitions kept."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9_\s]", " "), r"\s+")
    return F.filter(words, lambda w: F.length(w) > 2)


def sentences(text: Column) -> Column:
    """Trimmed sentences of more than 20 characters that do not start with #."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n+", " "), r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, trimmed), lambda s: (F.length(s) > 20) & ~s.startswith("#"))


def term_matches(sentence: Column, terms: Column) -> Column:
    """How many of the terms occur in the sentence, as substrings."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(sentence), t)))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4 + 0.5).cast("int"))


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def excerpt(text: Column, size: int = 180, trim: bool = False) -> Column:
    part = F.substring(text, 1, size)
    return F.concat(trimmed(part) if trim else part, F.lit("..."))


def extension(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, r"\."), -1))


def is_code_file(name: Column) -> Column:
    return extension(name).isin(CODE_EXTENSIONS)


def document_kind(name: Column) -> Column:
    """code, pdf or text, by the extension."""
    return F.when(is_code_file(name), "code").when(extension(name) == "pdf", "pdf").otherwise("text")


def url_filename(url: Column) -> Column:
    """The last segment of a URL's path; a default where it is empty."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last == "", "remote_document.txt").otherwise(last)


def highlight(text: Column, query: str, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The query's words of more than two characters, marked wherever they occur, in any case."""
    words = [re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in query.split() if len(w) > 2]
    return F.regexp_replace(text, f"(?i)({'|'.join(words)})", f"{before}$1{after}") if words else text
