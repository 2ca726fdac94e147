"""Text columns of captions: tokens, similarity, counts and the mechanical word rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and phrases that decide results.
STOP_WORDS = "a an the of in on at with and by to its from under over near into for as is are after before through across beside behind along while their his her they them it this that".split()
COUNT_WORDS = "one two three four five six adults adult people dancers dancer man woman men women person performers athletes players fighters".split()
FORBIDDEN = r"(?i)(^|[^a-z0-9_])(montage|cut to|cuts to|jump cut|transitions? to|cross-?fade|child|children|kid|kids|toddler|dog|dogs|cat|cats|horse|horses)([^a-z0-9_]|$)"
CONTINUOUS = r"(?i)(continuous|single|unbroken|one) (take|shot)|one continuous"
SPACE = r"[\x09-\x0D\x20]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    """The first n of words(); what follows them isn't split."""
    space, other = "[\\x09-\\x0D\\x20]", "[^\\x09-\\x0D\\x20]"
    return words(F.regexp_extract(F.coalesce(text, F.lit("")), rf"^{space}*+(?:{other}++(?:{space}++|\z)){{0,{n}}}", 0))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column, drop: list[str] = STOP_WORDS) -> Column:
    """Sorted distinct words of letters a-z and digits, without stop words."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]", " ")
    return F.array_sort(F.array_except(F.array_distinct(F.split(plain, " +")), F.array(*[F.lit(w) for w in ("", *drop)])))


def jaccard(a: Column, b: Column) -> Column:
    """Set similarity; 0 where a set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def forbidden_match(text: Column) -> Column:
    """The first forbidden word as it stands in the text, or empty."""
    return F.regexp_extract(text, FORBIDDEN, 2)


def has_continuous_phrase(text: Column) -> Column:
    return text.rlike(CONTINUOUS)


def mechanical_issue(caption: Column, scene: Column, action: Column, family: Column) -> Column:
    """The first rule that a caption breaks, or null. The scene limit is 24 words though its message says 20."""
    n, found = word_count(caption), forbidden_match(F.coalesce(caption, F.lit("")))
    restated = jaccard(tokens(action, STOP_WORDS + COUNT_WORDS), tokens(family, STOP_WORDS + COUNT_WORDS)) >= 0.7
    return (
        F.when((n < 60) | (n > 125), F.format_string("word count %d outside 60-125", n))
        .when(found != "", F.concat(F.lit("forbidden word: "), found))
        .when(~F.coalesce(has_continuous_phrase(caption), F.lit(False)), "missing continuous-shot phrase")
        .when(word_count(scene) > 24, "scene summary longer than 20 words")
        .when((F.coalesce(family, F.lit("")) != "") & restated, "action restates the family name; write a specific sibling move, variation or combination")
    )
