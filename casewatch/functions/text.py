"""Text clean-up with built-in regular expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Page HTML to Markdown: (pattern, replacement) lists and, in `MARKDOWN_TEXTS` and
# `MARKDOWN_LINE_ENDS`, plain (text, replacement), which is much cheaper. Tags are
# rewritten one by one rather than in pairs, and runs of blanks shrink before
# anything looks at line ends, so the cost stays linear in the text. No
# look-around, so other engines agree.
MARKDOWN_TAGS = [
    (
        r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<head\b[^>]*>.*?</head>",
        "",
    ),
    (r"(?i)<h([1-6])\b[^>]*>", "\n\n\x01$1 "),
    (r"(?i)</?(b|strong)\b[^>]*>", "**"),
    (r"(?i)</?(i|em)\b[^>]*>", "*"),
    (r"(?i)<a\b[^>]*href=\"([^\"]*)\"[^>]*>([^<]*)</a>", "[$2]($1)"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<tr\b[^>]*>", "\n| "),
    (r"(?i)</t[dh]>", " | "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(h[1-6]|p|div|section|article|ul|ol|table)\b[^>]*>", "\n\n"),
    (r"<[^>]+>", ""),
]
MARKDOWN_TEXTS = [(f"\x01{level}", "#" * level) for level in range(1, 7)] + [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", "\""),
    ("&amp;", "&"),
]
MARKDOWN_RUNS = [(r"[ \t\r]+", " ")]
MARKDOWN_LINE_ENDS = [(" \n", "\n"), ("\n ", "\n")]
MARKDOWN_PARAGRAPHS = [(r"\n\n\n+", "\n\n")]
BLANKS = " \n"


def replace_patterns(text: Column, steps) -> Column:
    return reduce(lambda c, step: F.regexp_replace(c, step[0], step[1]), steps, text)


def replace_texts(text: Column, steps) -> Column:
    return reduce(lambda c, step: F.replace(c, F.lit(step[0]), F.lit(step[1])), steps, text)


def html_to_markdown(column) -> Column:
    """Whole-page HTML as Markdown."""
    text = F.col(column) if isinstance(column, str) else column
    text = replace_texts(replace_patterns(text, MARKDOWN_TAGS), MARKDOWN_TEXTS)
    text = replace_texts(replace_patterns(text, MARKDOWN_RUNS), MARKDOWN_LINE_ENDS)
    return F.btrim(replace_patterns(text, MARKDOWN_PARAGRAPHS), F.lit(BLANKS))


def collapse_newlines(column) -> Column:
    """A line break and the blanks after it become one blank."""
    return F.regexp_replace(column, r"\n\s*", " ")


def to_object_path(column) -> Column:
    """Public object-store URL to the path Spark reads it by."""
    return F.concat(F.lit("s3a:/"), F.substring_index(column, "amazonaws.com", -1))
