"""Corpus operators: stories -> pairs, news records -> pairs, lemmatization.

Inputs and outputs are DataFrames; every step is a Column expression applied
row-locally, so a corpus job is a single narrow stage from scan to sink. The
only shuffle is the lexicon join when the lexicon is too large to ship.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.constants import HIGHLIGHT_MARKER
from precis.functions.text import (
    _col,
    cleanup,
    cleanup_lines,
    drop_newlines,
    newlines_to_space,
    squeeze_spaces,
    with_html_text,
    wrap_sentences,
)
from precis.functions.tokens import drop_punct_tokens, drop_stopwords, split_space, stopwords
from precis.operators.lookup import map_tokens


# ---------------------------------------------------------------------------
# Story files
# ---------------------------------------------------------------------------

def clean_story_text(content, strict_end: bool = False) -> Column:
    """Whole story text, cleaned line by line but in one pass per rule: line
    breaks are normalised to ``\\n`` (text-mode reading), then every line is
    stripped, cleaned and period-fixed by ``cleanup_lines``."""
    return cleanup_lines(F.regexp_replace(_col(content), r"\r\n|\r", "\n"), strip=True, strict_end=strict_end)


def with_story_lines(df: DataFrame, content_col: str, out_col: str = "lines", strict_end: bool = False) -> DataFrame:
    """Add the cleaned, non-empty lines (missing-period fix applied) of a story
    text. The cleaned text is its own projection, so it is computed once; no
    per-line lambda is evaluated."""
    tmp = f"_{out_col}_text"
    staged = df.withColumn(tmp, clean_story_text(F.col(content_col), strict_end))
    text = F.col(tmp)
    parts = F.split(text, "\n", -1)
    lines = F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(
        F.when(text == F.lit(""), F.array().cast("array<string>")).otherwise(parts)
    )
    return staged.withColumn(
        out_col, F.array_remove(lines, "")
    ).drop(tmp)


def split_story(df: DataFrame, lines_col: str = "lines") -> DataFrame:
    """Add ``article_lines`` (lines before the first ``@highlight`` line) and
    ``highlights`` (every non-marker line after it; the flag never resets).

    Each step is its own projection: the optimizer does not inline a costly
    array expression into several consumers, so every line is cleaned once."""
    lines = F.col(lines_col)
    marked = df.withColumn(
        "_first", F.array_position(F.transform(lines, lambda l: l.startswith(HIGHLIGHT_MARKER)), True)
    )
    first = F.col("_first")
    body = F.when(first == 0, lines).otherwise(F.slice(lines, F.lit(1), first - 1))
    tail = F.when(first == 0, F.array().cast("array<string>")).otherwise(
        F.filter(
            F.slice(lines, first + 1, F.greatest(F.size(lines) - first, F.lit(0))),
            lambda l: ~l.startswith(HIGHLIGHT_MARKER),
        )
    )
    return marked.withColumn("article_lines", body).withColumn("highlights", tail).drop("_first")


def filter_article_tokens(text, words) -> Column:
    """Split on single spaces, drop stop words and punctuation tokens, re-join."""
    tokens = drop_punct_tokens(drop_stopwords(split_space(text), words))
    return squeeze_spaces(F.array_join(tokens, " "))


def stories_to_pairs(df: DataFrame, id_col: str = "id", content_col: str = "content",
                     language: str = "english", strict_end: bool = False, keep=()) -> DataFrame:
    """(id, content) story texts -> (id, article, summary) and the columns ``keep``.
    ``strict_end`` uses the intended end-character list for the missing-period fix."""
    lined = with_story_lines(df.select(F.col(id_col).alias("id"), *keep, F.col(content_col).alias("_content")), "_content",
                             strict_end=strict_end)
    parsed = split_story(lined.drop("_content"))
    article = filter_article_tokens(F.array_join(F.col("article_lines"), " "), stopwords(language))
    summary = wrap_sentences(F.col("highlights"))
    return parsed.select(
        "id", *keep,
        squeeze_spaces(drop_newlines(article)).alias("article"),
        squeeze_spaces(drop_newlines(summary)).alias("summary"),
    )


# ---------------------------------------------------------------------------
# News records
# ---------------------------------------------------------------------------

def normalize_articles(df: DataFrame, html_col: str, out_col: str = "article", words=None,
                       lemmatize: bool = True) -> DataFrame:
    """HTML -> text -> clean-up -> (stop-word and punctuation filter) -> newlines
    to spaces. Lemma lookup, when wanted, is the step ``lemmatize_tokens``
    (see ``records_to_pairs``)."""
    staged = with_html_text(df, html_col, "_text")
    text = cleanup(F.col("_text"))
    if lemmatize:
        text = filter_article_tokens(text, words if words is not None else stopwords("russian"))
    return staged.withColumn(out_col, newlines_to_space(text)).drop("_text")


def records_to_pairs(df: DataFrame, id_col: str = "id", lexicon: DataFrame | None = None,
                     language: str = "russian", lemmatize: bool = True, keep=()) -> DataFrame:
    """(id, text=HTML, title) -> (id, article, summary) and the columns ``keep``; the
    title is kept raw."""
    words = stopwords(language)
    base = df.select(F.col(id_col).alias("id"), *keep, F.col("text").alias("_html"), F.col("title").alias("summary"))
    if not lemmatize or lexicon is None:
        out = normalize_articles(base, "_html", "article", words, lemmatize)
        return out.select("id", *keep, "article", "summary")
    staged = with_html_text(base, "_html", "_text").select(
        "id", *keep, split_space(cleanup(F.col("_text"))).alias("tokens"), "summary"
    )
    staged = lemmatize_tokens(staged, "tokens", lexicon)
    tokens = drop_punct_tokens(drop_stopwords(F.col("tokens"), words))
    article = newlines_to_space(squeeze_spaces(F.array_join(tokens, " ")))
    return staged.select("id", *keep, article.alias("article"), "summary")


# ---------------------------------------------------------------------------
# Lemmatization by lexicon
# ---------------------------------------------------------------------------

def lemmatize_tokens(df: DataFrame, tokens_col: str, lexicon: DataFrame,
                     form_col: str = "form", lemma_col: str = "lemma", way: str | None = None) -> DataFrame:
    """Replace every token that has an entry in ``lexicon(form, lemma)``;
    tokens without an entry are kept (a missing lexicon means identity)."""
    return map_tokens(df, tokens_col, lexicon, form_col, lemma_col, way=way)
