"""SQL common table expressions shared by the oracle queries (DuckDB dialect)."""

from __future__ import annotations

from plaudit import config as C
from plaudit.sources.driver_tables import ASPECTS, KEYWORDS, SENTIMENT

SPACE = r"\s\x0b\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD_CHAR = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"


def q(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return ", ".join(q(w) for w in items)


def cleaned(col: str) -> str:
    url = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
    control = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
    out = f"regexp_replace({col}, '{url}', ' ', 'g')"
    out = f"regexp_replace({out}, '{control}', '', 'g')"
    return f"trim(regexp_replace({out}, '[{SPACE}]+', ' ', 'g'))"


def label(star: str = "star") -> str:
    return f"CAST(CASE WHEN {star} >= 4 THEN 1 WHEN {star} <= 2 THEN 0 ELSE -1 END AS INT)"


def lexicon_p(col: str) -> str:
    tokens = f"string_split(regexp_replace(lower({col}), '[^a-z]+', ' ', 'g'), ' ')"
    pos = f"len(list_filter({tokens}, lambda w: w IN ({words(SENTIMENT.positive)})))"
    neg = f"len(list_filter({tokens}, lambda w: w IN ({words(SENTIMENT.negative)})))"
    return f"(({pos}) + 1.0::DOUBLE) / (({pos}) + ({neg}) + 2.0::DOUBLE)"


def spread(col: str, seed: int) -> str:
    return f"(((({col} + {seed}) % 2147483648) * {C.HASH_MULTIPLIER}) % 4294967296)"


REVIEWS = """reviews AS (
  SELECT d.doc_id AS row_id, d.source AS item, d.lang AS item_label,
         d.n_chars % 97 AS user_id, CAST(d.n_chars % 14 AS INT) AS day_no,
         CAST(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 5 WHEN l.quality = 1 THEN 4
                   WHEN l.quality = 0 AND l.toxic = 0 THEN 2 WHEN l.quality = 0 THEN 1
                   ELSE 3 END AS INT) AS star,
         CAST((d.doc_id * 37) % 400 AS INT) AS likes, d.text AS comment
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

CLEAN = f"""cleaned AS (
  SELECT * REPLACE ({cleaned("comment")} AS comment) FROM reviews
  WHERE comment IS NOT NULL AND comment NOT IN ({words(C.NA_TOKENS)})),
clean AS (SELECT * FROM cleaned WHERE length(comment) >= 4 AND star BETWEEN 1 AND 5)"""

UNIQUE = """uniq AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY item, user_id, comment ORDER BY row_id) AS rn
    FROM clean) WHERE rn = 1)"""

BINOMIAL = (
    "[(1-p_pos)*(1-p_pos)*(1-p_pos)*(1-p_pos), 4.0::DOUBLE*p_pos*(1-p_pos)*(1-p_pos)*(1-p_pos), "
    "6.0::DOUBLE*p_pos*p_pos*(1-p_pos)*(1-p_pos), 4.0::DOUBLE*p_pos*p_pos*p_pos*(1-p_pos), "
    "p_pos*p_pos*p_pos*p_pos]"
)


def scored(source: str) -> str:
    return f"""with_p AS (SELECT *, {lexicon_p("comment")} AS p_pos FROM {source}),
with_dist AS (SELECT *, CAST(CASE WHEN p_pos >= 0.5 THEN 1 ELSE 0 END AS INT) AS pred_sent,
  {BINOMIAL} AS dist FROM with_p),
scored AS MATERIALIZED (SELECT * EXCLUDE (dist),
  dist[1] + 2 * dist[2] + 3 * dist[3] + 4 * dist[4] + 5 * dist[5] AS exp_rating,
  CAST(list_position(dist, list_max(dist)) AS INT) AS pred_rating,
  list_max(dist) AS p_rating FROM with_dist)"""


def base(*parts: str, source: str = "clean") -> str:
    """WITH clause: reviews, clean, then ``parts``; ``source='uniq'`` adds deduplication."""
    chain = [REVIEWS, CLEAN]
    if source == "uniq":
        chain.append(UNIQUE)
    return "WITH " + ",\n".join([*chain, *parts]) + "\n"


def base_scored(*parts: str, source: str = "clean") -> str:
    return base(scored(source), *parts, source=source)


def _aspect_test(keywords) -> str:
    return " OR ".join(
        f"contains(lower(clause), {q(k.lower())})" if k.isascii() else f"contains(clause, {q(k)})"
        for k in keywords
    )


CLAUSES = f"""clause_list AS (
  SELECT row_id, item, likes, list_filter(list_transform(
    regexp_split_to_array(comment, {q(ASPECTS.clause_pattern)}), lambda c: trim(c)),
    lambda c: length(c) >= {ASPECTS.min_clause_chars}) AS cs FROM clean)"""

HITS = """numbered AS (
  SELECT row_id, item, likes, unnest(cs) AS clause, generate_subscripts(cs, 1) AS place FROM clause_list),
firsts AS (SELECT row_id, item, likes, clause, min(place) AS place FROM numbered GROUP BY ALL),
hits AS (SELECT * FROM (
  SELECT *, list_filter([{tests}], lambda a: a IS NOT NULL) AS aspects FROM firsts)
  WHERE len(aspects) > 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY place) - 1 AS pos FROM hits),
mentions AS MATERIALIZED (SELECT row_id, item, likes, CAST(pos AS INT) AS pos, clause, {p} AS p,
  unnest(aspects) AS aspect FROM ordered)""".format(
    tests=", ".join(
        f"CASE WHEN {_aspect_test(k)} THEN {q(a)} END" for a, k in ASPECTS.lexicon.items()
    ),
    p=lexicon_p("clause"),
)

LIKE_WEIGHT = "(1.0::DOUBLE + ln(1 + greatest(0, likes)))"
STRENGTH = f"2 * abs(p - 0.5::DOUBLE) * {LIKE_WEIGHT}"

RATES = f"""rates AS (
  SELECT item, aspect, count(*) AS mentions, avg(p) AS pos_rate,
         sum({LIKE_WEIGHT} * p) / sum({LIKE_WEIGHT}) AS like_weighted_pos_rate
  FROM mentions GROUP BY item, aspect)"""

EVIDENCE = f"""evidence AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY item, aspect, polarity
         ORDER BY strength DESC, clause, row_id) AS rank
  FROM (SELECT *, CASE WHEN p >= 0.5 THEN 'pos' ELSE 'neg' END AS polarity,
               {STRENGTH} AS strength FROM mentions))
  WHERE rank <= {ASPECTS.evidence})"""

ASPECT_CHOICE = f"""enough AS (SELECT * FROM rates WHERE mentions >= {ASPECTS.min_mentions}),
pros AS (SELECT * FROM (SELECT *, mentions * (pos_rate - {ASPECTS.positive_rate}::DOUBLE) AS gain,
  row_number() OVER (PARTITION BY item ORDER BY mentions * (pos_rate - {ASPECTS.positive_rate}::DOUBLE) DESC, aspect) AS rank
  FROM enough WHERE pos_rate >= {ASPECTS.positive_rate}) WHERE rank <= {ASPECTS.top_aspects}),
cons AS (SELECT * FROM (SELECT *, mentions * ({ASPECTS.negative_rate}::DOUBLE - pos_rate) AS gain,
  row_number() OVER (PARTITION BY item ORDER BY mentions * ({ASPECTS.negative_rate}::DOUBLE - pos_rate) DESC, aspect) AS rank
  FROM enough WHERE pos_rate <= {ASPECTS.negative_rate}) WHERE rank <= {ASPECTS.top_aspects}),
weak AS (SELECT * FROM (SELECT *,
  row_number() OVER (PARTITION BY item ORDER BY pos_rate, aspect) AS rank FROM enough
  WHERE item NOT IN (SELECT item FROM enough WHERE pos_rate <= {ASPECTS.negative_rate}))
  WHERE rank <= {ASPECTS.weak_aspects})"""

WORDS = f"""words AS (SELECT item, pred_sent, unnest(regexp_extract_all(lower(comment), '\\p{{L}}+')) AS word FROM scored),
bags AS (SELECT item, word, count(*) FILTER (WHERE pred_sent = 1) AS y,
  count(*) FILTER (WHERE pred_sent <> 1) AS x FROM words
  WHERE length(word) >= {KEYWORDS.min_chars} AND word NOT IN ({words(KEYWORDS.stop_words)}) GROUP BY item, word)"""

LOG_ODDS = f"""by_word AS (SELECT word, sum(y + x) AS bg FROM bags GROUP BY word),
by_item AS (SELECT item, sum(y) AS n_y, sum(x) AS n_x FROM bags GROUP BY item),
total AS (SELECT sum(y + x) AS t FROM bags),
prior AS (SELECT b.item, b.word, y, x, n_y, n_x, {KEYWORDS.prior}::DOUBLE * bg AS a,
  {KEYWORDS.prior}::DOUBLE * greatest(1, t) AS a0
  FROM bags b JOIN by_word USING (word) JOIN by_item ON b.item = by_item.item, total
  WHERE y + x >= {KEYWORDS.min_count}),
z AS (SELECT item, word, y, x,
  (ln((y + a) / greatest(1e-9, n_y + a0 - y - a)) - ln((x + a) / greatest(1e-9, n_x + a0 - x - a)))
  / sqrt(1 / (y + a) + 1 / (x + a)) AS z FROM prior)"""

STATS = f"""stats AS (
  SELECT item, count(*) AS n_reviews,
    count(*) FILTER (WHERE star >= 4) AS star_pos, count(*) FILTER (WHERE star <= 2) AS star_neg,
    count(*) FILTER (WHERE star = 3) AS star_mid,
    count(*) FILTER (WHERE pred_sent = 1) AS model_pos, count(*) FILTER (WHERE pred_sent = 0) AS model_neg,
    avg(pred_sent) AS model_pos_rate, avg(p_pos) AS p_pos_mean, avg(exp_rating) AS pred_rating_mean,
    avg(star) AS star_mean, CAST(sum(star) AS BIGINT) AS star_sum, CAST(sum(likes) AS BIGINT) AS likes_sum,
    avg(likes) AS likes_mean,
    count(*) FILTER (WHERE star >= 4) / count(*)::DOUBLE AS star_pos_rate
  FROM scored GROUP BY item),
prior_row AS (SELECT sum(star_sum) / sum(n_reviews)::DOUBLE AS m FROM stats),
bayes AS (SELECT stats.*, (star_sum + 100 * m) / (n_reviews + 100) AS bayes_rating FROM stats, prior_row),
scores AS (SELECT *, (bayes_rating - 1) / 4 * 10 AS rating_score, model_pos_rate * 10 AS sentiment_score,
  0.6::DOUBLE * ((bayes_rating - 1) / 4 * 10) + 0.4::DOUBLE * (model_pos_rate * 10) AS final_score,
  n_reviews / (n_reviews + 100)::DOUBLE AS confidence FROM bayes)"""

AD = C.AD_PATTERN.replace(r"\bwx\b", rf"(^|[^\p{{L}}\p{{N}}_])wx($|[^\p{{L}}\p{{N}}_])").replace(
    r"\bvx\b", rf"(^|[^\p{{L}}\p{{N}}_])vx($|[^\p{{L}}\p{{N}}_])"
).replace(r"@\w+", f"@{WORD_CHAR}+")

SPAM_BASE = f"""normed AS (SELECT *,
  regexp_replace(comment, '[^\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9]', '', 'g') AS norm FROM scored),
chars AS (SELECT *, string_split(norm, '') AS cs FROM normed),
keyed AS (SELECT * EXCLUDE (cs), CASE WHEN length(norm) >= 12 THEN substring(array_to_string(list_filter(cs,
  lambda c, i: NOT (i > 1 AND c = cs[i - 1] AND ((i < len(cs) AND c = cs[i + 1]) OR (i > 2 AND c = cs[i - 2])))), ''), 1, 12) END AS template_key,
  regexp_matches(comment, {q(AD)}, 'i') AS ad,
  coalesce((p_pos >= 0.9 AND star <= 2) OR (p_pos <= 0.1 AND star >= 4), false) AS rating_mismatch,
  likes >= 200 AND length(comment) <= 40 AS like_bomb, length(norm) <= 5 AS low_info FROM chars),
pairs AS (SELECT norm, count(DISTINCT item) AS text_movie_count, count(*) AS text_total_count FROM keyed GROUP BY norm),
openings AS (SELECT item, template_key, count(*) AS n FROM keyed WHERE template_key IS NOT NULL GROUP BY ALL),
sized AS (SELECT k.*, count(*) OVER (PARTITION BY k.item, k.norm) AS dup_same_movie_size,
  text_movie_count, text_total_count, coalesce(o.n, 0) AS template_size,
  count(*) OVER (PARTITION BY user_id) AS user_total,
  count(*) OVER (PARTITION BY user_id, k.item) AS user_movie_count,
  count(*) OVER (PARTITION BY user_id, k.item, day_no) AS user_movie_day_count,
  count(*) OVER (PARTITION BY k.item, day_no) AS movie_day_count
  FROM keyed k JOIN pairs USING (norm)
  LEFT JOIN openings o ON k.item = o.item AND k.template_key = o.template_key),
cut AS (SELECT quantile_cont(movie_day_count, 0.999) AS day_burst_p999 FROM sized)"""

_POINTS = " + ".join(f"CASE WHEN {s} THEN {w} ELSE 0 END" for s, w in C.SIGNAL_WEIGHTS.items())
_REASONS = ", ".join(f"CASE WHEN {s} THEN '{s}' END" for s in C.SIGNALS)

SPAM = SPAM_BASE + f""",
flagged AS (SELECT *, dup_same_movie_size >= 2 AS dup_same_movie, text_movie_count >= 3 AS dup_cross_movie,
  template_size >= 5 AS template, user_movie_day_count >= 2 AS user_burst, user_movie_count >= 3 AS user_repeat,
  movie_day_count > day_burst_p999 AS movie_day_burst FROM sized, cut),
pointed AS (SELECT *, least(100, {_POINTS}) AS spam_points,
  array_to_string(list_filter([{_REASONS}], lambda r: r IS NOT NULL), '|') AS reasons FROM flagged),
detail AS MATERIALIZED (SELECT *, spam_points / 100::DOUBLE AS spam_score, spam_points >= 50 AS is_suspect FROM pointed)"""

SPAM_SUMMARY = """summary AS (SELECT item, count(*) AS n_reviews, count(*) FILTER (WHERE is_suspect) AS n_suspect,
  avg(is_suspect::INT) AS suspect_rate, sum(spam_points) / count(*)::DOUBLE / 100 AS mean_spam_score,
  max(day_burst_p999) AS day_burst_p999, """ + ", ".join(
    f"count(*) FILTER (WHERE {s}) AS spam_{s}" for s in C.SIGNALS
) + " FROM detail GROUP BY item)"
