"""Scalar functions on titles, tokens and spans, as ``Column`` builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed-class words that cannot name an entity on their own.
STOP_WORDS = """a about above across after again against all almost alone along already also although always am among an and another any
anyone anything are around as at back be became because become been before behind being below between both but by can cannot could did do
does doing done down during each either else enough etc even ever every everyone everything few first for former from full get give go had
has have he hence her here hers herself him himself his how however i if in indeed into is it its itself just keep last latter least less
made make many may me meanwhile might mine more most mostly much must my myself name neither never next no nobody none nor not nothing now
of off often on once one only onto or other others our ours out over own part per perhaps please put quite rather really same say see seem
several she should show side since so some someone something sometimes still such take than that the their them themselves then there
therefore these they this those through thus to together too top toward towards under until up upon us used using various very via was we
well were what when where whether which while who whole whom whose why will with within without would yet you your yours""".split()
# Pronouns, for pruning clusters without a tagger.
PRONOUNS = "i me my mine myself you your yours he him his himself she her hers herself it its itself we us our ours they them their theirs who whom whose".split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def format_wikilink(title: Column | str) -> Column:
    """Blanks as underscores, first letter upper-cased; empty and null give null."""
    t = F.replace(_c(title), F.lit(" "), F.lit("_"))
    return F.when(F.length(t) > 0, F.concat(F.upper(F.left(t, F.lit(1))), F.substring(t, 2, 2**31 - 1)))


def redirect_title(title: Column | str) -> Column:
    """The older key of redirects: as above, with all but the first letter lower-cased."""
    t = F.replace(_c(title), F.lit(" "), F.lit("_"))
    return F.when(F.length(t) > 0, F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 2**31 - 1))))


def capitalize_tokens(tokens: Column | str) -> Column:
    """First token capitalised (its tail in lower case), the others as they are."""
    return F.transform(_c(tokens), lambda t, i: F.when(i == 0, F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 2**31 - 1)))).otherwise(t))


def flatten_tokens(tokens: Column | str) -> Column:
    """All tokens of all sentences; null sentences count as empty, null tokens keep their place."""
    return F.flatten(F.transform(F.coalesce(_c(tokens), F.array().cast("array<array<string>>")), lambda s: F.coalesce(s, F.array().cast("array<string>"))))


def alias_tokens(alias: Column | str) -> Column:
    """The shared tokenizer of aliases and documents: words and single signs."""
    return F.regexp_extract_all(_c(alias), F.lit(r"[\p{L}\p{M}\p{N}]+(?:['’.\-][\p{L}\p{M}\p{N}]+)*|[^\s\p{L}\p{M}\p{N}]"), F.lit(0))


def bad_alias(tokens: Column | str) -> Column:
    """No token, or nothing but stop words or punctuation."""
    t = _c(tokens)
    stop = F.array(*map(F.lit, STOP_WORDS))
    return (F.size(t) <= 0) | F.forall(t, lambda x: F.array_contains(stop, F.lower(x))) | F.forall(t, lambda x: x.rlike(r"^\p{P}+$"))


def sentence_windows(tokens: Column | str, size: int = 3) -> Column:
    """Windows of ``size`` sentences, stride one; fewer sentences give none."""
    t = _c(tokens)
    n = F.coalesce(F.size(t), F.lit(0))
    last = F.greatest(n - size, F.lit(0))
    return F.when(n >= size, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(t, i + 1, F.lit(size)))).otherwise(F.array().cast("array<array<array<string>>>"))


def sentence_offsets(tokens: Column | str, block: int = 256) -> Column:
    """Token offset of every sentence in the flattened text.

    Summed in two levels (within blocks of sentences, and over blocks), so long texts don't cost the square of their length.
    """
    sizes = F.transform(_c(tokens), lambda s: F.coalesce(F.size(s), F.lit(0)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)

    def offsets(n: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / block).cast("int")), lambda k: total(F.slice(n, k * block + 1, F.lit(block))))
        before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
        place = lambda i: F.floor(i / block).cast("int")
        return F.get(F.transform(F.array(before), lambda p: F.transform(n, lambda x, i: F.get(p, place(i)) + total(F.slice(n, place(i) * block + 1, i % block)))), 0)

    return F.get(F.transform(F.array(sizes), lambda n: F.when(F.size(n) > 0, offsets(n)).when(F.size(n) == 0, F.array().cast("array<int>"))), 0)


def shift_spans(clusters: Column | str, by: Column | int) -> Column:
    """Clusters with all their positions moved."""
    k = by if isinstance(by, Column) else F.lit(by)
    return F.transform(_c(clusters), lambda c: F.transform(c, lambda m: F.struct((m["start"] + k).cast("int").alias("start"), (m["end"] + k).cast("int").alias("end"))))


def first_start(cluster: Column | str) -> Column:
    return F.array_min(F.transform(_c(cluster), lambda m: m["start"]))


def span_text(flat: Column | str, start: Column, end: Column) -> Column:
    """Words of a half-open span, joined by blanks."""
    return F.array_join(F.slice(_c(flat), F.greatest(start, F.lit(0)) + 1, F.greatest(end - start, F.lit(0))), " ")


def zip_pairs(relation: Column | str, parent: Column | str) -> Column:
    """Relation and parent side by side, as long as the shorter of both; nulls count as empty."""
    r, p = F.coalesce(_c(relation), F.array().cast("array<string>")), F.coalesce(_c(parent), F.array().cast("array<string>"))
    n = F.least(F.size(r), F.size(p))
    return F.arrays_zip(F.slice(r, F.lit(1), n).alias("relation"), F.slice(p, F.lit(1), n).alias("parent"))
