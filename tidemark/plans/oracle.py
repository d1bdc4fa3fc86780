"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from tidemark.functions.text import default_stop_words

# --- text cleaning as SQL expressions, with patterns of its own --------------------------------------

_BLANK_SET = r"\t-\r\x1c-\x1f\x{85}\p{Z}"
# one pass from left to right: comments, elements without visible text, declarations, tags
_MARKUP = (
    r"(?is)<!--.*?-->"
    + "".join(rf"|<{e}(?:\s[^>]*)?>.*?(?:</{e}\s*>|\z)" for e in ("script", "style", "template"))
    + r"""|<[!?][^>]*>|</?[a-z](?:"[^"]*"|'[^']*'|[^'">])*>"""
)
# Words of topic names in capitals.
_CAPITALS = "ai gpu rbi gdp ipl un eu us uk".split()


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _replace(expr: str, pattern: str, to: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {to}, 'g')"


def _unescape(e: str) -> str:
    """The named references that the given pages hold; the ampersand comes last, so nothing is read twice."""
    for pattern, char in (("&copy;?", "©"), ("&middot;?", "·"), ("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">")):
        e = _replace(e, pattern, q(char))
    return _replace(e, "&amp;?", q("&"))


def _strip(plain: str) -> str:
    bare = _replace(plain, _MARKUP, "chr(1)")
    nodes = f"list_filter(string_split({bare}, chr(1)), lambda n: n <> '')"
    blank = r"regexp_full_match(n, '[ \n\t\f\r]+')"
    tidy = (
        f"list_transform({nodes}, lambda n: CASE WHEN {blank} THEN CASE WHEN contains(n, chr(10)) "
        "THEN chr(10) ELSE ' ' END ELSE n END)"
    )
    joined = _unescape(f"array_to_string({tidy}, ' ')")
    return f"CASE WHEN contains({plain}, '<') AND contains({plain}, '>') THEN {joined} ELSE {plain} END"


def _light(e: str) -> str:
    no_url = _replace(e, rf"(?:https?://|www\.)[^{_BLANK_SET}]+", "' '")
    return f"trim({_replace(no_url, f'[{_BLANK_SET}]+', q(' '))})"


def _lemma(t: str) -> str:
    return (
        f"CASE WHEN length({t}) > 5 AND {t} LIKE '%ies' THEN left({t}, length({t}) - 3) || 'y' "
        f"WHEN length({t}) > 4 AND {t} LIKE '%s' AND NOT regexp_matches({t}, '(ss|us|is)$') "
        f"THEN left({t}, length({t}) - 1) ELSE {t} END"
    )


def _content(t: str) -> str:
    words = ", ".join(q(w) for w in default_stop_words())
    return f"length({t}) > 2 AND NOT list_contains([{words}], {t}) AND NOT regexp_full_match({t}, '[0-9]+')"


def _raw_words(e: str) -> str:
    return f"string_split({_replace(f'lower({e})', '[^a-z0-9-]+', q(' '))}, ' ')"


def _heavy_list(light: str) -> str:
    lemmas = f"list_transform({_raw_words(light)}, lambda t: {_lemma('t')})"
    return f"list_filter({lemmas}, lambda t: {_content('t')})"


def _stamp(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


# --- views -----------------------------------------------------------------------------------------

ARTICLES = """
art0 AS (
  SELECT *, CAST(floor(doc_id / 3.0) AS INTEGER) AS g, split_part(text, chr(10), 1) AS t1,
         doc_id % 14 AS wave, (doc_id * 5 + 3) % 13 AS other
  FROM documents),
articles_v AS (
  SELECT doc_id AS article_id, t1 AS title,
         CASE WHEN contains(text, chr(10)) THEN substr(text, length(t1) + 2) ELSE '' END AS description,
         source, 'https://' || source || '.example/' || CAST(doc_id % 700 AS VARCHAR) AS url,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(CASE WHEN g % 4 = 0 THEN greatest(wave, other)
           WHEN g % 4 = 1 THEN least(wave, other) ELSE wave END AS INTEGER))
           + to_seconds((doc_id * 37) % 86400) AS published,
         '' AS author, lang AS category,
         CAST(CASE WHEN doc_id % 11 = 0 THEN -1 ELSE g % 8 END AS INTEGER) AS cluster
  FROM art0)"""

NAMED = ARTICLES + """,
named_v AS (SELECT *, CASE WHEN cluster <> -1 THEN 'Topic ' || CAST(cluster AS VARCHAR) END AS topic_name FROM articles_v)"""

EVENT_ARTICLES = """
articles_v AS (
  SELECT event_id AS article_id, ts AS published, CAST(user_id AS VARCHAR) AS source,
         CAST(CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3
              WHEN 'view' THEN 4 ELSE -1 END AS INTEGER) AS cluster
  FROM events)"""

VECTORS = """
vec_v AS (
  SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS embedding, label AS cluster,
         's' || CAST(vec_id % 7 AS VARCHAR) AS source,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(vec_id % 14 AS INTEGER)) AS published
  FROM embeddings),
unit_v AS (
  SELECT *, CASE WHEN len > 0 THEN list_transform(embedding, lambda x: x / len) ELSE embedding END AS u
  FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS len FROM vec_v))"""

NEAR = VECTORS + """,
pair_v AS (
  SELECT a.article_id AS a, b.article_id AS b, a.cluster AS ca, b.cluster AS cb,
         list_dot_product(a.u, b.u) AS cos, list_distance(a.embedding, b.embedding) AS d,
         abs(date_diff('day', CAST(a.published AS DATE), CAST(b.published AS DATE))) AS gap
  FROM unit_v a, unit_v b WHERE a.article_id <> b.article_id),
sim_v AS (SELECT * FROM pair_v WHERE cos >= 0.35 AND gap <= 3)"""

STORIES = NEAR + """,
reach(a, b) AS (SELECT a, b FROM sim_v UNION SELECT r.a, s.b FROM reach r JOIN sim_v s ON s.a = r.b),
comp_v AS (SELECT a AS article_id, min(least(a, b)) AS component FROM reach GROUP BY a),
size_v AS (SELECT component, count(*) AS size FROM comp_v GROUP BY component),
story_v AS (SELECT *, row_number() OVER (ORDER BY size DESC, component) AS story_id FROM size_v),
told_v AS (
  SELECT v.article_id, v.source, v.published, 'title ' || CAST(v.article_id AS VARCHAR) AS title, c.component, s.size,
         CAST(coalesce(s.story_id, -1) AS INTEGER) AS story_id
  FROM vec_v v LEFT JOIN comp_v c USING (article_id) LEFT JOIN story_v s USING (component))"""

CENTERS = VECTORS + """,
dim_v AS (SELECT article_id, cluster, unnest(range(1, len(embedding) + 1)) AS i, embedding, u FROM unit_v),
mean_v AS (SELECT cluster, i, avg(embedding[i]) AS m FROM dim_v WHERE cluster <> -1 GROUP BY ALL)"""

ASSIGNED = CENTERS + """,
len_v AS (SELECT cluster, sqrt(sum(m * m)) AS len FROM mean_v GROUP BY cluster),
cos_v AS (
  SELECT d.article_id, m.cluster, round(sum(d.u[d.i] * m.m) / any_value(l.len), 12) AS cos
  FROM dim_v d JOIN mean_v m USING (i) JOIN len_v l ON l.cluster = m.cluster GROUP BY d.article_id, m.cluster),
best_v AS (
  SELECT article_id, cluster, cos, row_number() OVER (PARTITION BY article_id ORDER BY cos DESC, cluster) AS r FROM cos_v),
assign_v AS (SELECT article_id, CAST(CASE WHEN cos >= 0.3 THEN cluster ELSE -1 END AS INTEGER) AS cluster FROM best_v WHERE r = 1)"""

KNN = NEAR + """,
knn_v AS (
  SELECT a AS src, b AS dst, d, CAST(row_number() OVER (PARTITION BY a ORDER BY round(d * d, 12), b) AS INTEGER) AS rank
  FROM pair_v),
core_v AS (SELECT src AS article_id, max(d) AS core FROM knn_v WHERE rank <= 9 GROUP BY src)"""


# A spanning tree grown from the lowest article: each step takes the nearest one outside and brings its edges in.
PRIM = KNN + """,
w_v AS MATERIALIZED (
  SELECT p.a, p.b, greatest(p.d, x.core, y.core) AS w
  FROM pair_v p JOIN core_v x ON x.article_id = p.a JOIN core_v y ON y.article_id = p.b),
root_v AS (SELECT min(article_id) AS root, count(*) AS n FROM vec_v),
prim AS (
  SELECT 1 AS step, v.article_id AS node, v.article_id = root AS done, w.w AS reach, CAST(0 AS DOUBLE) AS taken, n
  FROM vec_v v CROSS JOIN root_v LEFT JOIN w_v w ON w.a = root AND w.b = v.article_id
  UNION ALL
  SELECT step + 1, p.node, p.done OR p.node = p.pick, least(p.reach, w.w), p.least, n
  FROM (SELECT *, first_value(node) OVER (ORDER BY done, reach, node) AS pick, first_value(reach) OVER (ORDER BY done, reach, node) AS least
        FROM prim WHERE step < n) p
  LEFT JOIN w_v w ON w.a = p.pick AND w.b = p.node)"""


def cleaned() -> str:
    raw = _replace("coalesce(title, '') || '. ' || coalesce(description, '')", f"^[{_BLANK_SET}]+|[{_BLANK_SET}]+$", "''")
    return (
        ARTICLES
        + f""",
raw_v AS (SELECT *, {_unescape(raw)} AS plain FROM articles_v),
light_v AS (SELECT *, {_light(_strip('plain'))} AS embedding_text FROM raw_v),
clean_v AS (SELECT *, {_heavy_list('embedding_text')} AS words FROM light_v),
tok_v AS (
  SELECT * EXCLUDE (words), array_to_string(words, ' ') AS tfidf_text,
         regexp_extract_all(array_to_string(words, ' '), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks
  FROM clean_v),
gram_v AS (
  SELECT *, list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1])) AS grams
  FROM tok_v),
post_v AS (
  SELECT article_id, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT article_id, unnest(grams) AS term FROM gram_v) GROUP BY ALL)"""
    )


VOCAB = """,
df_v AS (SELECT term, CAST(count(*) AS BIGINT) AS df, CAST(sum(tf) AS BIGINT) AS total FROM post_v GROUP BY term),
vocab_v AS (
  SELECT * FROM df_v WHERE df >= (SELECT CASE WHEN count(*) > 50 THEN 2 ELSE 1 END FROM documents)
  ORDER BY total DESC, term LIMIT 20000)"""


def letter_counts(text: str) -> str:
    """List of how often each small letter occurs, of length 1 unless there is none."""
    counts = f"list_transform(string_split('a b c d e f g h i j k l m n o p q r s t u v w x y z', ' '), lambda c: length({text}) - length(replace({text}, c, '')))"
    size = f"greatest(sqrt(list_sum(list_transform({counts}, lambda x: x * x))), 1e-12)"
    return f"list_transform({counts}, lambda x: x / {size})"


def semantic_keywords() -> str:
    ctes = cleaned() + f""",
head_v AS (
  SELECT cluster, string_agg(tfidf_text, ' ' ORDER BY article_id) AS doc FROM (
    SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY article_id) AS i FROM tok_v WHERE cluster <> -1)
  WHERE i <= 60 GROUP BY cluster),
center_v AS (
  SELECT cluster, {letter_counts("doc")} AS center, regexp_extract_all(doc, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS toks FROM head_v),
terms_v AS (
  SELECT DISTINCT cluster, unnest(list_concat(toks, list_transform(range(1, len(toks)), lambda i: toks[i] || ' ' || toks[i + 1]))) AS term
  FROM center_v),
scored_v AS (
  SELECT cluster, term, round(list_inner_product({letter_counts("term")}, center), 9) AS score FROM terms_v JOIN center_v USING (cluster)),
best_v AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, term) AS rank FROM scored_v)"""
    return sel(ctes, "SELECT cluster AS topic_id, rank, term, score FROM best_v WHERE rank <= 8")


def classes() -> str:
    return cleaned() + """,
ends_v AS (
  SELECT cluster, toks[-1] AS tail, lead(toks[1]) OVER (PARTITION BY cluster ORDER BY article_id) AS next
  FROM gram_v WHERE cluster <> -1 AND len(toks) > 0),
cls_v AS (
  SELECT cluster, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT cluster, unnest(grams) AS term FROM gram_v WHERE cluster <> -1
        UNION ALL SELECT cluster, tail || ' ' || next FROM ends_v WHERE next IS NOT NULL)
  GROUP BY ALL),
raw_c AS (
  SELECT *, (1 + ln(tf)) * (ln((1 + (SELECT count(DISTINCT cluster) FROM articles_v WHERE cluster <> -1))
         / (1 + count(*) OVER (PARTITION BY term))) + 1) AS raw
  FROM cls_v),
rank_v AS (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY raw DESC, term DESC) AS rank FROM raw_c)"""


def greedy() -> str:
    return classes() + """,
greedy(cluster, rank, picked) AS (
  SELECT DISTINCT cluster, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]) FROM raw_c
  UNION ALL
  SELECT g.cluster, r.rank,
         CASE WHEN len(list_filter(g.picked, lambda p: contains(p, r.term) OR contains(r.term, p))) > 0
              THEN g.picked ELSE list_append(g.picked, r.term) END
  FROM greedy g JOIN rank_v r ON r.cluster = g.cluster AND r.rank = g.rank + 1
  WHERE len(g.picked) < 10),
kw_v AS (SELECT cluster AS topic_id, arg_max(picked, rank) AS keywords FROM greedy GROUP BY cluster)"""


def coherence() -> str:
    return greedy() + """,
words_v AS (SELECT topic_id, unnest(range(1, least(len(keywords), 8) + 1)) AS rank, keywords FROM kw_v),
held_v AS (
  SELECT w.topic_id, w.rank, p.article_id
  FROM (SELECT topic_id, rank, keywords[rank] AS term FROM words_v) w JOIN post_v p USING (term)),
one_v AS (SELECT topic_id, rank, count(*) AS n FROM held_v GROUP BY ALL),
two_v AS (
  SELECT a.topic_id, a.rank AS ra, b.rank AS rb, count(*) AS n
  FROM held_v a JOIN held_v b ON a.topic_id = b.topic_id AND a.article_id = b.article_id AND a.rank < b.rank
  GROUP BY ALL),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
pair_v AS (
  SELECT a.topic_id, a.n / nd.n AS pa, b.n / nd.n AS pb, coalesce(t.n, 0) / nd.n AS pab
  FROM one_v a JOIN one_v b ON a.topic_id = b.topic_id AND a.rank < b.rank
  LEFT JOIN two_v t ON t.topic_id = a.topic_id AND t.ra = a.rank AND t.rb = b.rank CROSS JOIN nd),
coh_v AS (
  SELECT k.topic_id, coalesce(avg(CASE WHEN pab = 0 THEN -1 WHEN pab = 1 THEN 1
           ELSE ln(pab / (pa * pb + 1e-12) + 1e-12) / -ln(pab + 1e-12) END), 0.0) AS coherence
  FROM kw_v k LEFT JOIN pair_v p USING (topic_id) GROUP BY k.topic_id)"""


def names() -> str:
    acronyms = ", ".join(q(a) for a in _CAPITALS)
    word = f"CASE WHEN list_contains([{acronyms}], w) THEN upper(w) ELSE upper(left(w, 1)) || lower(substr(w, 2)) END"
    phrase = f"array_to_string(list_transform(string_split(k, ' '), lambda w: {word}), ' ')"
    return f""",
chosen_v AS (
  SELECT topic_id, keywords, CASE WHEN len(list_filter(keywords, lambda k: NOT contains(k, ' '))) >= 2
         THEN list_filter(keywords, lambda k: NOT contains(k, ' ')) ELSE keywords END AS chosen FROM kw_v),
name_v AS (
  SELECT topic_id, CASE WHEN len(keywords) = 0 THEN 'Miscellaneous'
         ELSE array_to_string(list_transform(chosen[1:3], lambda k: {phrase}), ' · ') END AS topic FROM chosen_v),
uname_v AS (
  SELECT topic_id, CASE WHEN i > 1 THEN topic || ' (' || CAST(i AS VARCHAR) || ')' ELSE topic END AS topic
  FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY topic_id) AS i FROM name_v))"""


COUNTS = """,
cnt_v AS (
  SELECT CAST(published AS DATE) AS day, cluster AS topic_id, count(*) AS n
  FROM articles_v WHERE cluster <> -1 GROUP BY ALL),
span_v AS (SELECT min(day) AS a, max(day) AS b, date_diff('day', min(day), max(day)) + 1 AS d FROM cnt_v),
cal_v AS (
  SELECT t.topic_id, CAST(c.day AS DATE) AS day
  FROM (SELECT DISTINCT topic_id FROM cnt_v) t,
       (SELECT unnest(generate_series(a, b, INTERVAL 1 DAY)) AS day FROM span_v) c),
full_v AS (
  SELECT cal_v.day, cal_v.topic_id, CAST(coalesce(n, 0) AS BIGINT) AS n
  FROM cal_v LEFT JOIN cnt_v USING (day, topic_id))"""

TREND = COUNTS + """,
w_v AS (SELECT *, greatest(1, least(3, d // 2)) AS w FROM span_v WHERE d >= 2),
per_v AS (
  SELECT f.topic_id, CAST(sum(n) AS BIGINT) AS articles,
         CAST(sum(CASE WHEN date_diff('day', day, b) < w THEN n ELSE 0 END) AS BIGINT) AS recent,
         CAST(sum(CASE WHEN date_diff('day', day, b) >= w AND date_diff('day', day, b) < 2 * w THEN n ELSE 0 END) AS BIGINT)
           AS previous,
         regr_slope(n, date_diff('day', a, day)) AS slope, avg(n) AS mean
  FROM full_v f, w_v GROUP BY f.topic_id),
src_v AS (
  SELECT cluster AS topic_id, count(DISTINCT source) AS sources,
         count(DISTINCT CASE WHEN date_diff('day', CAST(published AS DATE), b) < w THEN source END) AS recent_sources
  FROM articles_v, w_v WHERE cluster <> -1 GROUP BY cluster),
part_v AS (
  SELECT *, (recent - previous) / greatest(previous, 1) AS growth_rate,
         recent / greatest(sum(recent) OVER (), 1) AS recent_activity,
         recent_sources / greatest(sources, 1) AS source_diversity, slope / greatest(mean, 1e-9) AS velocity
  FROM per_v JOIN src_v USING (topic_id)),
score_v AS (
  SELECT *, round_even(0.35 * least(greatest(growth_rate, 0.0), 2.0) / 2
           + 0.25 * recent_activity / greatest(max(recent_activity) OVER (), 1e-9)
           + 0.20 * source_diversity + 0.20 * least(greatest(velocity, 0.0), 0.5) / 0.5, 3) AS emerging_score
  FROM part_v),
trend_v AS (
  SELECT *, 'Topic ' || CAST(topic_id AS VARCHAR) AS topic,
         CASE WHEN emerging_score >= 0.60 THEN '🔥 Rising' WHEN emerging_score >= 0.40 OR growth_rate > 0.15 THEN '↑ Growing'
              WHEN growth_rate < -0.15 THEN '↓ Declining' ELSE '→ Stable' END AS trend
  FROM score_v)"""

TREND_COLS = (
    "topic_id, topic, articles, recent, previous, round(growth_rate, 6) AS growth_rate, "
    "round(recent_activity, 6) AS recent_activity, round(source_diversity, 6) AS source_diversity, "
    "round(velocity, 6) AS velocity, round(emerging_score, 6) AS emerging_score, trend"
)

TOPIC_COLS = """
sum_v AS (
  SELECT cluster AS topic_id, count(*) AS articles, 100 * count(*) / (SELECT count(*) FROM articles_v) AS share_pct,
         count(DISTINCT source) AS sources, min(published) AS first_seen, max(published) AS last_seen
  FROM articles_v WHERE cluster <> -1 GROUP BY cluster)"""

SIMPLE_TOPICS = "," + TOPIC_COLS + """,
simple_v AS (
  SELECT *, 'Topic ' || CAST(topic_id AS VARCHAR) AS topic, 'k, ' || CAST(topic_id AS VARCHAR) AS keywords,
         topic_id / 10 AS coherence FROM sum_v)"""

PLACED = NAMED + """,
placed_v AS (SELECT *, (article_id * 7 % 101) / 8 AS x, (article_id * 13 % 97) / 8 AS y FROM named_v)"""

DATES = EVENT_ARTICLES + """,
forms_v AS (SELECT article_id, date_trunc('second', published) AS ts FROM articles_v),
parsed_v AS (
  SELECT article_id, CASE article_id % 6 WHEN 0 THEN ts WHEN 1 THEN ts WHEN 2 THEN date_trunc('day', ts)
         WHEN 3 THEN ts - INTERVAL 330 MINUTE WHEN 4 THEN date_trunc('day', ts) END AS published
  FROM forms_v)"""

FEED = """
feed_v AS (
  SELECT 'feed' || CAST(page_id % 5 AS VARCHAR) AS feed, page_id AS pos,
         replace(trim(regexp_extract(html, '<title>([^<]*)', 1)), '&amp;', '&') AS title, url, page_id AS i,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(page_id % 14 AS INTEGER)) + to_seconds((page_id * 37) % 86400) AS t
  FROM pages)"""

# The first 15 items of each file of 100 ids; the newest file of a feed tells its status.
FETCHED = FEED + """,
fetch_v AS (
  SELECT *, pos // 100 AS part, row_number() OVER (PARTITION BY feed, pos // 100 ORDER BY pos) - 1 AS place FROM feed_v),
newest_v AS (
  SELECT feed, least(count(*), 15) AS n FROM fetch_v f
  WHERE part = (SELECT max(part) FROM fetch_v g WHERE g.feed = f.feed) GROUP BY feed)"""

STORE = ARTICLES + """,
batch_v AS (
  SELECT article_id, title, CASE WHEN article_id % 23 = 0 THEN NULL ELSE url END AS url FROM articles_v),
stored_v AS (SELECT url FROM articles_v WHERE published < TIMESTAMP '2024-01-03 00:00:00'),
fresh_v AS (
  SELECT article_id, title, url FROM (
    SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS i FROM batch_v WHERE url IS NOT NULL)
  WHERE i = 1 AND url NOT IN (SELECT url FROM stored_v)
  UNION ALL SELECT article_id, title, url FROM batch_v WHERE url IS NULL)"""

FIRST_TITLES = ARTICLES + """,
dedup_v AS (
  SELECT article_id, title, source FROM (
    SELECT *, row_number() OVER (PARTITION BY title, source ORDER BY article_id) AS i FROM articles_v) WHERE i = 1)"""

DAYS = "published >= TIMESTAMP '2024-01-04 00:00:00' AND published < TIMESTAMP '2024-01-10 00:00:00'"


def sel(ctes: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.lstrip()}\n{body}"


def parsed_feed(author: str) -> str:
    return sel(
        FEED,
        "SELECT feed, pos, coalesce(title, '') AS title, CASE WHEN i % 2 = 0 THEN trim('about ' || title) ELSE '' END AS description, "
        f"feed AS source, url, {_stamp('t - INTERVAL 2 HOUR')} AS published, "
        f"CASE WHEN i % 7 = 0 THEN {q(author)} ELSE '' END AS author, "
        "CASE WHEN i % 3 = 0 THEN 'world' ELSE '' END AS category FROM feed_v",
    )


FILLED = ARTICLES + """,
in_v AS (
  SELECT article_id AS ord, CASE WHEN article_id % 17 = 0 THEN '  ' ELSE title END AS title, description,
         CASE WHEN article_id % 13 <= 1 OR source IS NULL OR source = '' THEN 'Unknown' ELSE source END AS source, url,
         CASE WHEN article_id % 19 <> 0 THEN published END AS published, '' AS author, '' AS category
  FROM articles_v),
fill_v AS (SELECT * REPLACE (coalesce(published, (SELECT max(published) FROM in_v)) AS published) FROM in_v)"""


def normalize_articles() -> str:
    ctes = FILLED + """,
keep_v AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title, source ORDER BY ord) AS i
                 FROM fill_v WHERE trim(title) <> '') WHERE i = 1)"""
    return sel(
        ctes,
        "SELECT row_number() OVER (ORDER BY ord) - 1 AS article_id, title, description, source, url, "
        f"{_stamp('published')} AS published, author, category FROM keep_v",
    )


def pages_light() -> str:
    return f"""p0 AS (SELECT page_id, {_unescape('html')} AS plain FROM pages),
p1 AS (SELECT page_id, {_strip('plain')} AS stripped FROM p0),
p2 AS (SELECT page_id, {_light('stripped')} AS light FROM p1)"""


def doc_words() -> str:
    return f"w_v AS (SELECT * FROM (SELECT DISTINCT unnest({_raw_words('text')}) AS word FROM documents) WHERE word <> '')"


def topic_rounded(view: str, more: str = "") -> str:
    return (
        "SELECT topic_id, topic, articles, round(share_pct, 6) AS share_pct, sources, keywords, "
        f"round(coherence, 6) AS coherence, {_stamp('first_seen')} AS first_seen, {_stamp('last_seen')} AS last_seen{more} "
        f"FROM {view}"
    )


def topic_summary() -> str:
    ctes = coherence() + names() + "," + TOPIC_COLS + """,
done_v AS (
  SELECT s.*, n.topic, array_to_string(k.keywords[1:8], ', ') AS keywords, c.coherence
  FROM sum_v s LEFT JOIN uname_v n USING (topic_id) LEFT JOIN kw_v k USING (topic_id) LEFT JOIN coh_v c USING (topic_id))"""
    return sel(ctes, topic_rounded("done_v"), True)


SQL = {
    "emerging_topics": lambda: sel(ARTICLES + TREND, f"SELECT {TREND_COLS} FROM trend_v"),
    "emerging_topics_events": lambda: sel(EVENT_ARTICLES + TREND, f"SELECT {TREND_COLS} FROM trend_v"),
    "parse_published": lambda: sel(DATES, f"SELECT article_id, {_stamp('published')} AS published FROM parsed_v"),
    "fill_published": lambda: sel(
        DATES,
        f"SELECT article_id, {_stamp('coalesce(published, (SELECT max(published) FROM parsed_v))')} AS published FROM parsed_v",
    ),
    "normalize_articles": normalize_articles,
    "dedup_title_source": lambda: sel(FIRST_TITLES, "SELECT * FROM dedup_v"),
    "assign_article_id": lambda: sel(
        FIRST_TITLES,
        "SELECT article_id AS row, row_number() OVER (ORDER BY article_id) - 1 AS article_id FROM dedup_v",
    ),
    "parse_feed": lambda: parsed_feed("Ann"),
    "parse_feed_atom": lambda: parsed_feed("Joe"),
    "feed_limit": lambda: sel(
        FEED,
        "SELECT feed, pos, url FROM (SELECT *, row_number() OVER (PARTITION BY feed ORDER BY pos) AS r FROM feed_v) WHERE r <= 20",
    ),
    "feed_status": lambda: sel(
        FEED,
        "SELECT f.feed, CASE WHEN count(v.feed) > 0 THEN CAST(least(count(v.feed), 100) AS VARCHAR) || ' articles' "
        "ELSE 'no entries (feed empty or unreachable)' END AS status "
        "FROM (SELECT 'feed' || CAST(unnest(range(7)) AS VARCHAR) AS feed) f LEFT JOIN feed_v v USING (feed) GROUP BY f.feed",
    ),
    "save_new_articles": lambda: sel(STORE, "SELECT * FROM fresh_v"),
    "inserted_count": lambda: sel(STORE, "SELECT count(*) AS inserted FROM fresh_v"),
    "stored_count": lambda: sel(
        STORE, "SELECT (SELECT count(*) FROM fresh_v) + (SELECT count(*) FROM stored_v) AS articles"
    ),
    "export_articles": lambda: sel(
        ARTICLES,
        f"SELECT * REPLACE ({_stamp('published')} AS published) FROM articles_v "
        f"WHERE source IN ('src1', 'src2', 'src3') AND {DAYS}",
    ),
    "preview_articles": lambda: sel(
        ARTICLES,
        f"SELECT title, source, {_stamp('published')} AS published, (SELECT count(*) FROM articles_v) AS n_articles, "
        "(SELECT count(DISTINCT source) FROM articles_v) AS n_sources FROM articles_v ORDER BY article_id LIMIT 20",
    ),
    "strip_html": lambda: sel(pages_light(), "SELECT page_id, stripped AS text FROM p1"),
    "light_clean": lambda: sel(pages_light(), "SELECT page_id, light AS text FROM p2"),
    "heavy_clean": lambda: sel(
        pages_light(), f"SELECT page_id, array_to_string({_heavy_list('light')}, ' ') AS text FROM p2"
    ),
    "simple_lemma": lambda: sel(doc_words(), f"SELECT word, {_lemma('word')} AS lemma FROM w_v"),
    "stopword_filter": lambda: sel(doc_words(), f"SELECT word FROM w_v WHERE {_content('word')}"),
    "preprocess_articles": lambda: sel(cleaned(), "SELECT article_id, embedding_text, tfidf_text FROM tok_v"),
    "article_search": lambda: sel(
        ARTICLES,
        "SELECT article_id, title FROM articles_v WHERE regexp_matches(title, '(?i)tion(er|al)? (the|of)') "
        "OR regexp_matches(description, '(?i)tion(er|al)? (the|of)')",
    ),
    "tokens": lambda: sel(
        cleaned(),
        "SELECT article_id, i - 1 AS pos, toks[i] AS token FROM (SELECT article_id, toks, unnest(range(1, len(toks) + 1)) AS i FROM tok_v)",
    ),
    "ngrams": lambda: sel(cleaned(), "SELECT term, CAST(sum(tf) AS BIGINT) AS n FROM post_v GROUP BY term"),
    "term_freq": lambda: sel(cleaned(), "SELECT * FROM post_v"),
    "doc_freq": lambda: sel(cleaned() + VOCAB, "SELECT * FROM df_v WHERE df >= 2"),
    "vocab_topk": lambda: sel(
        cleaned() + VOCAB, "SELECT * FROM df_v WHERE df >= 2 ORDER BY total DESC, term LIMIT 20000"
    ),
    "tfidf": lambda: sel(
        cleaned()
        + VOCAB
        + """,
raw_t AS (
  SELECT article_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w
  FROM post_v JOIN vocab_v USING (term))""",
        "SELECT article_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY article_id)), 6) AS weight FROM raw_t",
    ),
    "normalize_vectors": lambda: sel(
        VECTORS,
        "SELECT article_id, i - 1 AS pos, round(u[i], 6) AS value FROM (SELECT article_id, u, unnest(range(1, len(u) + 1)) AS i FROM unit_v)",
    ),
    "class_term_counts": lambda: sel(classes(), "SELECT * FROM cls_v"),
    "class_tfidf": lambda: sel(
        classes(),
        "SELECT cluster, term, tf, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY cluster)), 6) AS weight FROM raw_c",
    ),
    "class_term_rank": lambda: sel(classes(), "SELECT cluster, rank, term FROM rank_v WHERE rank <= 100"),
    "cluster_keywords": lambda: sel(
        greedy(),
        "SELECT topic_id, rank, keywords[rank] AS term FROM (SELECT *, unnest(range(1, len(keywords) + 1)) AS rank FROM kw_v)",
        True,
    ),
    "npmi_coherence": lambda: sel(coherence(), "SELECT topic_id, round(coherence, 6) AS coherence FROM coh_v", True),
    "average_coherence": lambda: sel(
        coherence(), "SELECT round(avg(coherence), 6) AS avg_coherence FROM coh_v", True
    ),
    "topic_names": lambda: sel(greedy() + names(), "SELECT topic_id, topic FROM name_v", True),
    "unique_topic_names": lambda: sel(
        """n_v AS (SELECT DISTINCT CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) AS topic_id,
          'Source ' || right(source, 1) AS topic FROM documents),
i_v AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY topic_id) AS i FROM n_v)""",
        "SELECT topic_id, CASE WHEN i > 1 THEN topic || ' (' || CAST(i AS VARCHAR) || ')' ELSE topic END AS topic FROM i_v",
    ),
    "label_articles": lambda: sel(
        greedy() + names(),
        "SELECT a.article_id, a.cluster, u.topic AS topic_name FROM articles_v a LEFT JOIN uname_v u ON u.topic_id = a.cluster",
        True,
    ),
    "sample_titles": lambda: sel(
        ARTICLES,
        "SELECT cluster AS topic_id, string_agg(title, ' | ' ORDER BY article_id) AS titles FROM (SELECT *, row_number() "
        "OVER (PARTITION BY cluster ORDER BY article_id) AS r FROM articles_v WHERE cluster <> -1) WHERE r <= 5 GROUP BY cluster",
    ),
    "daily_counts": lambda: sel(
        ARTICLES + COUNTS, "SELECT strftime(day, '%Y-%m-%d') AS day, topic_id, n FROM full_v"
    ),
    "daily_counts_wide": lambda: sel(
        EVENT_ARTICLES + COUNTS,
        "SELECT strftime(day, '%Y-%m-%d') AS day, "
        + ", ".join(f'CAST(sum(CASE WHEN topic_id = {t} THEN n ELSE 0 END) AS BIGINT) AS "{t}"' for t in range(5))
        + " FROM full_v GROUP BY day",
    ),
    "window_compare": lambda: sel(EVENT_ARTICLES + TREND, "SELECT topic_id, articles, recent, previous FROM per_v"),
    "source_diversity": lambda: sel(
        EVENT_ARTICLES + TREND,
        "SELECT topic_id, sources, recent_sources, round(source_diversity, 6) AS diversity FROM part_v",
    ),
    "velocity": lambda: sel(
        EVENT_ARTICLES + TREND,
        "SELECT topic_id, round(slope, 6) AS slope, round(velocity, 6) AS velocity FROM part_v",
    ),
    "emerging_score": lambda: sel(
        EVENT_ARTICLES + TREND,
        "SELECT topic_id, round(growth_rate, 6) AS growth_rate, round(emerging_score, 6) AS emerging_score FROM score_v",
    ),
    "trend_label": lambda: sel(ARTICLES + TREND, "SELECT topic_id, trend FROM trend_v"),
    "topic_summary": topic_summary,
    "topic_with_trend": lambda: sel(
        ARTICLES + TREND + SIMPLE_TOPICS,
        topic_rounded(
            "simple_v s LEFT JOIN (SELECT topic_id, trend, emerging_score, growth_rate FROM trend_v) USING (topic_id)",
            ", trend, round(emerging_score, 6) AS emerging_score, round(growth_rate, 6) AS growth_rate",
        ),
    ),
    "topic_table": lambda: sel(
        ARTICLES + TREND + SIMPLE_TOPICS,
        "SELECT topic_id, topic, s.articles, round(share_pct, 6) AS share, s.sources, coalesce(t.trend, '') AS trend, keywords, "
        "round((SELECT greatest(max(share_pct), 1) FROM simple_v), 6) AS share_scale "
        "FROM simple_v s LEFT JOIN (SELECT topic_id, trend FROM trend_v) t USING (topic_id)",
    ),
    "coherence_table": lambda: sel(
        ARTICLES + SIMPLE_TOPICS, "SELECT topic, articles, round(coherence, 6) AS coherence FROM simple_v"
    ),
    "topic_distribution": lambda: sel(
        ARTICLES + SIMPLE_TOPICS, "SELECT topic, articles, round(share_pct, 6) AS share_pct FROM simple_v"
    ),
    "overview": lambda: sel(
        ARTICLES + TREND,
        "SELECT count(*) AS n_articles, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_topics, "
        "count(DISTINCT source) AS n_sources, count(*) FILTER (cluster = -1) AS n_noise, "
        "(SELECT count(*) FROM trend_v WHERE trend = '🔥 Rising') AS n_rising, "
        "round(100 * count(*) FILTER (cluster = -1) / count(*), 6) AS noise_pct FROM articles_v",
    ),
    "top_emerging": lambda: sel(
        ARTICLES + TREND,
        "SELECT topic_id, trend, topic, recent, round(emerging_score, 6) AS emerging_score, "
        "round(least(greatest(emerging_score, 0), 1), 6) AS progress FROM trend_v ORDER BY trend_v.emerging_score DESC, topic_id LIMIT 4",
    ),
    "trend_lines": lambda: sel(
        ARTICLES + TREND,
        "SELECT topic_id, strftime(day, '%Y-%m-%d') AS day, n FROM full_v WHERE topic_id IN "
        "(SELECT topic_id FROM trend_v ORDER BY emerging_score DESC, topic_id LIMIT 3)",
    ),
    "trend_table": lambda: sel(
        ARTICLES + TREND,
        "SELECT trend, topic, articles, previous AS prev_window, recent AS recent_window, round(growth_rate * 100, 6) AS growth_pct, "
        "round(source_diversity, 6) AS source_diversity, round(velocity, 6) AS velocity, round(emerging_score, 6) AS emerging_score FROM trend_v",
    ),
    "topic_latest": lambda: sel(
        ARTICLES,
        f"SELECT {_stamp('published')} AS published, source, title FROM articles_v WHERE cluster = 3 "
        "ORDER BY articles_v.published DESC, article_id LIMIT 50",
    ),
    "source_mix": lambda: sel(
        ARTICLES,
        "SELECT source, count(*) AS articles FROM articles_v WHERE cluster = 3 GROUP BY source ORDER BY articles DESC, source LIMIT 15",
    ),
    "article_filter": lambda: sel(
        NAMED,
        f"SELECT article_id, topic_name, source, {_stamp('published')} AS published FROM named_v "
        "WHERE (regexp_matches(title, '(?i)tion') OR regexp_matches(description, '(?i)tion')) "
        "AND topic_name IN ('Topic 1', 'Topic 2', 'Topic 5') AND source IN ("
        + ", ".join(f"'src{n}'" for n in range(10))
        + f") AND {DAYS}",
    ),
    "stored_filter": lambda: sel(
        ARTICLES,
        f"SELECT title, source, url, {_stamp('published')} AS published FROM ("
        "SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN article_id % 3 = 0 THEN 0 ELSE 1 END, article_id) AS i FROM articles_v) "
        "WHERE i = 1 AND (regexp_matches(title, '(?i)tion') OR regexp_matches(description, '(?i)tion')) AND source IN ("
        + ", ".join(f"'src{n}'" for n in range(10))
        + f") AND {DAYS}",
    ),
    "article_list": lambda: sel(
        NAMED, f"SELECT {_stamp('published')} AS published, source, topic_name, title, url FROM named_v"
    ),
    "article_labels": lambda: sel(
        NAMED, "SELECT article_id, left(concat_ws(' ', title, description), 100) AS label FROM named_v"
    ),
    "filter_options": lambda: sel(
        NAMED,
        "SELECT 'first_day' AS kind, strftime(min(published), '%Y-%m-%d') AS value FROM named_v "
        "UNION ALL SELECT 'last_day', strftime(max(published), '%Y-%m-%d') FROM named_v "
        "UNION ALL SELECT DISTINCT 'source', source FROM named_v WHERE source IS NOT NULL "
        "UNION ALL SELECT DISTINCT 'topic', topic_name FROM named_v WHERE topic_name IS NOT NULL",
    ),
    "article_detail": lambda: sel(
        NAMED,
        "SELECT title, source, strftime(published, '%d %b %Y %H:%M') AS published_text, "
        "coalesce(topic_name, 'Noise') AS topic_name, description, url FROM named_v WHERE article_id = 11",
    ),
    "map_points": lambda: sel(
        PLACED,
        "SELECT article_id, x, y, coalesce(topic_name, 'Noise / Unclustered') AS topic_name, title, source, "
        "strftime(published, '%d %b %Y') AS published_text FROM placed_v WHERE cluster <> -1",
    ),
    "map_labels": lambda: sel(
        PLACED, "SELECT topic_name, median(x) AS x, median(y) AS y FROM placed_v WHERE cluster <> -1 GROUP BY topic_name"
    ),
    "similar_pairs": lambda: sel(
        NEAR, "SELECT a AS left_id, b AS right_id, round(cos, 6) AS cosine FROM sim_v WHERE a < b"
    ),
    "story_components": lambda: sel(
        STORIES, "SELECT article_id, component, size FROM told_v WHERE component IS NOT NULL", True
    ),
    "story_groups": lambda: sel(STORIES, "SELECT article_id, story_id FROM told_v", True),
    "story_summary": lambda: sel(
        STORIES,
        "SELECT story_id, count(*) AS n, count(DISTINCT source) AS outlets, left(arg_min(title, article_id), 90) AS label "
        "FROM told_v WHERE story_id <> -1 GROUP BY story_id ORDER BY n DESC, story_id LIMIT 15",
        True,
    ),
    "story_count": lambda: sel(
        STORIES, "SELECT count(DISTINCT story_id) AS stories FROM told_v WHERE story_id <> -1", True
    ),
    "story_members": lambda: sel(
        STORIES, f"SELECT source, {_stamp('published')} AS published, title FROM told_v WHERE story_id = 1", True
    ),
    "cluster_centroids": lambda: sel(CENTERS, "SELECT cluster, i - 1 AS pos, round(m, 6) AS value FROM mean_v"),
    "assign_new": lambda: sel(ASSIGNED, "SELECT * FROM assign_v"),
    "cluster_counts": lambda: sel(
        ARTICLES,
        "SELECT count(*) AS n_articles, count(DISTINCT CASE WHEN cluster <> -1 THEN cluster END) AS n_clusters, "
        "count(*) FILTER (cluster = -1) AS n_noise, round(100 * count(*) FILTER (cluster = -1) / count(*), 6) AS noise_pct "
        "FROM articles_v",
    ),
    "silhouette": lambda: sel(
        NEAR
        + """,
per_v AS (SELECT a, ca, cb, avg(d) AS m FROM pair_v WHERE ca <> -1 AND cb <> -1 GROUP BY ALL),
ab_v AS (SELECT a, max(CASE WHEN ca = cb THEN m END) AS x, min(CASE WHEN ca <> cb THEN m END) AS y FROM per_v GROUP BY a)""",
        "SELECT round(avg(CASE WHEN x IS NULL THEN 0 ELSE (y - x) / greatest(x, y) END), 6) AS silhouette FROM ab_v",
    ),
    "davies_bouldin": lambda: sel(
        CENTERS
        + """,
gap_v AS (
  SELECT d.article_id, d.cluster, sqrt(sum((d.embedding[d.i] - m.m) ** 2)) AS gap
  FROM dim_v d JOIN mean_v m ON m.cluster = d.cluster AND m.i = d.i GROUP BY ALL),
s_v AS (SELECT cluster, avg(gap) AS s FROM gap_v GROUP BY cluster),
far_v AS (
  SELECT a.cluster AS x, b.cluster AS y, sqrt(sum((a.m - b.m) ** 2)) AS far
  FROM mean_v a JOIN mean_v b ON a.i = b.i AND a.cluster <> b.cluster GROUP BY ALL)""",
        "SELECT round(avg(r), 6) AS davies_bouldin FROM (SELECT x, max((a.s + b.s) / far) AS r FROM far_v "
        "JOIN s_v a ON a.cluster = x JOIN s_v b ON b.cluster = y GROUP BY x)",
    ),
    "knn_graph": lambda: sel(
        NEAR,
        "SELECT src, dst, rank, round(1 - cos, 6) AS dist FROM (SELECT a AS src, b AS dst, cos, CAST(row_number() OVER "
        "(PARTITION BY a ORDER BY round(2 - 2 * cos, 12), b) AS INTEGER) AS rank FROM pair_v) WHERE rank <= 15",
    ),
    "core_distance": lambda: sel(KNN, "SELECT article_id, round(core, 6) AS core FROM core_v"),
    "mutual_reachability": lambda: sel(
        KNN,
        "SELECT src, dst, round(greatest(d, a.core, b.core), 6) AS weight FROM knn_v JOIN core_v a ON a.article_id = src "
        "JOIN core_v b ON b.article_id = dst WHERE rank <= 9",
    ),
    "mst_edges": lambda: sel(
        PRIM,
        "SELECT CAST(max(step) - 1 AS BIGINT) AS edges, round(sum(taken), 6) AS weight FROM (SELECT DISTINCT step, taken FROM prim)",
        recursive=True,
    ),
    "batch_embed": lambda: sel(
        cleaned() + f", unit_t AS (SELECT article_id, {letter_counts('embedding_text')} AS u FROM tok_v)",
        "SELECT article_id, CAST(unnest(range(26)) AS INTEGER) AS pos, round(unnest(u), 6) AS value FROM unit_t",
    ),
    "semantic_keywords": semantic_keywords,
    "stream_ingest": lambda: sel(
        FILLED,
        f"SELECT ord AS row, title, description, source, url, {_stamp('published')} AS published, author, category "
        "FROM fill_v WHERE trim(title) <> ''",
    ),
    "stream_feeds": lambda: sel(
        FETCHED,
        "SELECT part, feed, place AS pos, coalesce(title, '') AS title, CASE WHEN i % 2 = 0 THEN trim('about ' || title) ELSE '' END AS description, "
        f"feed AS source, url, {_stamp('t - INTERVAL 2 HOUR')} AS published, "
        "CASE WHEN i % 7 <> 0 THEN '' WHEN i % 5 >= 3 THEN 'Joe' ELSE 'Ann' END AS author, "
        "CASE WHEN i % 3 = 0 THEN 'world' ELSE '' END AS category FROM fetch_v WHERE place < 15",
    ),
    "stream_feed_status": lambda: sel(
        FETCHED,
        "SELECT f.feed, coalesce(CAST(n AS VARCHAR) || ' articles', 'no entries (feed empty or unreachable)') AS status "
        "FROM (SELECT 'feed' || CAST(unnest(range(7)) AS VARCHAR) AS feed) f LEFT JOIN newest_v USING (feed)",
    ),
    "stream_dedup": lambda: sel(
        ARTICLES,
        "SELECT title, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY article_id) AS r FROM articles_v) WHERE r = 1",
    ),
    "stream_daily_counts": lambda: sel(
        EVENT_ARTICLES + COUNTS,
        "SELECT strftime(day, '%Y-%m-%d') AS day, topic_id, n FROM cnt_v "
        "WHERE day + INTERVAL 1 DAY <= (SELECT max(published) FROM articles_v WHERE cluster <> -1) - INTERVAL 3 DAY",
    ),
    "stream_late_counts": lambda: sel(
        EVENT_ARTICLES + COUNTS, "SELECT strftime(day, '%Y-%m-%d') AS day, topic_id, n FROM full_v"
    ),
    "stream_assign": lambda: sel(ASSIGNED, "SELECT * FROM assign_v"),
    "stream_trends": lambda: sel(EVENT_ARTICLES + TREND, f"SELECT {TREND_COLS} FROM trend_v"),
}
