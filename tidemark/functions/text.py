"""Text cleaning as column expressions that stay on the JVM."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks as the cleaning rules see them (Unicode white space).
WS = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = "[^" + WS[1:]
BLANKS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

# News filler words.
NEWS_STOP_WORDS = """
said says say new report reports reported according news read updated just also will one two year
years week today monday tuesday wednesday thursday friday saturday sunday
""".split()

# The 318 English stop words of the cleaning rules.
ENGLISH_STOP_WORDS = """
a about above across after afterwards again against all almost alone along already also although always am
among amongst amoungst amount an and another any anyhow anyone anything anyway anywhere are around as at back
be became because become becomes becoming been before beforehand behind being below beside besides between
beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down
due during each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything
everywhere except few fifteen fifty fill find fire first five for former formerly forty found four from front
full further get give go had has hasnt have he hence her here hereafter hereby herein hereupon hers herself
him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter
latterly least less ltd made many may me meanwhile might mill mine more moreover most mostly move much must my
myself name namely neither never nevertheless next nine no nobody none noone nor not nothing now nowhere of
off often on once one only onto or other others otherwise our ours ourselves out over own part per perhaps
please put rather re same see seem seemed seeming seems serious several she should show side since sincere six
sixty so some somehow someone something sometime sometimes somewhere still such system take ten than that the
their them themselves then thence there thereafter thereby therefore therein thereupon these they thick thin
third this those though three through throughout thru thus to together too top toward towards twelve twenty
two un under until up upon us very via was we well were what whatever when whence whenever where whereafter
whereas whereby wherein whereupon wherever whether which while whither who whoever whole whom whose why will
with within without would yet you your yours yourself yourselves
""".split()


@lru_cache(maxsize=1)
def default_stop_words() -> tuple[str, ...]:
    """The 318 English words plus the news words, sorted."""
    return tuple(sorted({*ENGLISH_STOP_WORDS, *NEWS_STOP_WORDS}))


@lru_cache(maxsize=1)
def _entity_table() -> tuple[dict[str, str], list[str]]:
    """Named references from the standard library; the second part may stand without a semicolon."""
    return dict(html5), sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))


@lru_cache(maxsize=1)
def _control_points() -> dict[int, str]:
    """HTML reads references to 0x80-0x9F as windows-1252."""
    return {i: bytes([i]).decode("cp1252", errors="ignore") or chr(i) for i in range(0x80, 0xA0)}


def _literal_map(d: dict) -> Column:
    """One constant map; written as JSON so that the plan holds a single literal, not one per entry."""
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _code_point(n: Column) -> Column:
    wide = F.lpad(F.hex(n), 8, "0")
    bad = (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    silent = n.between(1, 8) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF)
    return (
        F.when(n.isNull() | bad, "�")
        .when(n.between(0x80, 0x9F), F.element_at(_literal_map(_control_points()), n.cast("string")))
        .when((n == 11) | silent | (n.bitwiseAND(0xFFFE) == 0xFFFE), "")
        .otherwise(F.decode(F.unhex(wide), "UTF-32"))
    )


def unescape(text) -> Column:
    """Character references to characters, in one pass (``&amp;lt;`` gives ``&lt;``)."""
    text = F.col(text) if isinstance(text, str) else text
    table, bare = _entity_table()
    names = _literal_map(table)

    def piece(p: Column) -> Column:
        full = F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9]*;)", 1)
        short = F.regexp_extract(p, f"^&({'|'.join(bare)})", 1)
        dec = F.regexp_extract(p, "^&#([0-9]+)", 1)
        hexa = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+)", 1)
        num_rest = F.regexp_replace(p, "^&#(?:[xX][0-9a-fA-F]+|[0-9]+);?", "")
        # References past 0x10FFFF are out of range whatever their length, so short ones are enough to parse.
        dec_value = F.when(F.length(F.ltrim(dec, F.lit("0"))) <= 9, dec.try_cast("long"))
        hex_value = F.when(F.length(F.ltrim(hexa, F.lit("0"))) <= 8, F.conv(hexa, 16, 10).try_cast("long"))
        return (
            F.when(~p.startswith("&"), p)
            .when(dec != "", F.concat(_code_point(dec_value), num_rest))
            .when(hexa != "", F.concat(_code_point(hex_value), num_rest))
            .when(
                (full != "") & F.element_at(names, full).isNotNull(),
                F.concat(F.element_at(names, full), F.substr(p, F.length(full) + 2)),
            )
            .when(short != "", F.concat(F.element_at(names, short), F.substr(p, F.length(short) + 2)))
            .otherwise(p)
        )

    def decoded(t: Column) -> Column:
        return F.when(t.contains("&"), F.array_join(F.transform(F.split(t, "(?=&)"), piece), "")).otherwise(t)

    return let(text, decoded)


# Markup that carries no visible text, removed whole.
HIDDEN = [
    r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)",
    r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)",
    r"(?is)<template\b[^>]*>.*?(?:</template\s*>|\z)",
    r"(?s)<!--.*?-->",
    r"(?s)<[!?][^>]*>",
]
TAG = r"""<(?:/?[a-zA-Z])(?:[^'">]+|"[^"]*"|'[^']*')*>"""
_TAG_JVM = r"""<(?:/?[a-zA-Z])(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
MARK = "\x01"


def strip_html(text) -> Column:
    """Visible text of HTML: references decoded first, text nodes joined by one blank."""
    text = F.col(text) if isinstance(text, str) else text
    blank = F.lit("^[ \\n\\t\\f\\r]+$")

    def node_text(n: Column) -> Column:
        return F.when(F.rlike(n, blank), F.when(n.contains("\n"), "\n").otherwise(" ")).otherwise(n)

    def visible(plain: Column) -> Column:
        bare = plain
        for pattern in [*HIDDEN, _TAG_JVM]:
            bare = F.regexp_replace(bare, pattern, MARK)
        nodes = F.filter(F.split(bare, MARK), lambda n: n != "")
        joined = unescape(F.array_join(F.transform(nodes, node_text), " "))
        return F.when(plain.contains("<") & plain.contains(">"), joined).otherwise(plain)

    return let(unescape(F.coalesce(text, F.lit(""))), visible)


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def light_clean(text) -> Column:
    """No markup, no URLs, single blanks: the form for sentence models."""
    no_url = F.regexp_replace(strip_html(text), rf"https?://{NOT_WS}+|www\.{NOT_WS}+", " ")
    return collapse_blanks(no_url)


def simple_lemma(tok: Column) -> Column:
    """``policies`` to ``policy``, plural ``s`` off, else unchanged."""
    n = F.length(tok)
    plural = tok.endswith("s") & ~F.rlike(tok, F.lit("(ss|us|is)$"))
    return (
        F.when((n > 5) & tok.endswith("ies"), F.concat(F.substr(tok, F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & plural, F.substr(tok, F.lit(1), n - 1))
        .otherwise(tok)
    )


@lru_cache(maxsize=8)
def _literals(words: tuple[str, ...], session_key: int) -> list[Column]:
    """Literal columns, built once per session: hundreds of gateway calls otherwise."""
    return [F.lit(w) for w in words]


def is_content_word(tok: Column, stop_words=None) -> Column:
    words = _literals(tuple(stop_words or default_stop_words()), id(SparkContext._jvm))
    return (F.length(tok) > 2) & ~tok.isin(words) & ~F.rlike(tok, F.lit("^[0-9]+$"))


def content_lemmas(light: Column, stop_words=None) -> Column:
    """Lemmas of the content words. Runs under three characters never survive, so they are not cut out."""
    runs = F.regexp_extract_all(F.lower(light), F.lit("[a-z0-9-]{3,}"), F.lit(0))
    return F.filter(F.transform(runs, simple_lemma), lambda t: is_content_word(t, stop_words))


def heavy_tokens(text, stop_words=None) -> Column:
    return content_lemmas(light_clean(text), stop_words)


def heavy_clean(text, stop_words=None) -> Column:
    """Lower-case lemmas without stop words, numbers and punctuation: the form for term counting."""
    return F.array_join(heavy_tokens(text, stop_words), " ")


def raw_text(title, description) -> Column:
    joined = F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(description, F.lit("")))
    return F.btrim(joined, F.lit(BLANKS))


def preprocess_articles(articles: DataFrame, stop_words=None) -> DataFrame:
    """Adds ``embedding_text`` and ``tfidf_text``; the markup is stripped once for both."""
    raw = raw_text(F.col("title"), F.col("description"))
    light = articles.withColumn("embedding_text", light_clean(raw))
    kept = content_lemmas(F.col("embedding_text"), stop_words)
    return light.withColumn("tfidf_text", F.array_join(kept, " "))


def article_search(title, description, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive regular expression (or literal text) in title or description."""
    import re

    rx = F.lit("(?iu)" + (re.escape(pattern) if literal else pattern))
    return F.coalesce(F.rlike(title, rx), F.lit(False)) | F.coalesce(F.rlike(description, rx), F.lit(False))
