"""Texts cut off by field limits: word trigrams inside texts against those at ends, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, join_dimension, written
from .main_content import own_lines

#: Words seen less often elsewhere are too rare to judge by; shorter ones decide then.
LEAST = 2
#: What ends a text without a full stop is cut if it stands at ends in at most this share of its occurrences.
BARE_SHARE = 0.25
#: What ends a text with a full stop is cut (an abbreviation, an ordinal) if it stands inside lines at least so often and at ends in at most this share.
STOP_LEAST, STOP_SHARE = 20, 0.02

#: The words c of distinct lines; a and b stand before them. The words of a line come out of a generator, so that they are not pushed below a union and copied there.
_CELLS = r"""
WITH split AS (SELECT final, explode(array(split(if(final AND (endswith(line, '…') OR endswith(line, '...') OR endswith(line, '…]') OR endswith(line, '...]') OR endswith(line, '\u0085')), regexp_replace(line, '\\s*(…|[.]{{3}}|\\[…\\]|\\[[.]{{3}}\\])$', ''), line), ' '))) AS t FROM {lines}),
cells AS (SELECT final, t, posexplode(t) AS (i, c) FROM split)
SELECT coalesce(get(t, i - 2), '^') AS a, coalesce(get(t, i - 1), '^') AS b, c, i + 1 = size(t) AS ends, final FROM cells
"""
#: w is c without punctuation. bare_in and stop_in: 1 inside, -1 at an end, 0 neither; an end is for w the text's last word, bare, and for c with a stop that of a line.
_WORDS = r"""
WITH last AS (SELECT *, substring(c, -1, 1) BETWEEN 'a' AND 'z' AS plain FROM {cells}),
words AS (SELECT *, if(plain, c, rtrim('.,;:!?…"”“»«', c)) AS bare, if(plain, false, substring(rtrim('"”“»)', c), -1, 1) IN ('.', '!', '?')) AS stop FROM last)
SELECT *, if(bare = '', c, bare) AS w, CASE WHEN ends AND final AND (bare = c OR bare = '') THEN -1 WHEN ends AND NOT stop THEN 0 ELSE 1 END AS bare_in, CASE WHEN NOT stop THEN 0 WHEN ends THEN -1 ELSE 1 END AS stop_in FROM words
"""
#: Grams with their occurrences inside and at ends: a hash of their kind and words. B3 and B2 end with a bare word, E3 and E1 with a stop.
_GRAMS = r"""
WITH each AS (SELECT bare_in, stop_in, posexplode(if(stop_in = 0, array(xxhash64('B3', a, b, w), xxhash64('B2', b, w)), array(xxhash64('B3', a, b, w), xxhash64('B2', b, w), xxhash64('E3', a, b, c), xxhash64('E1', c)))) AS (k, gram) FROM {words}),
seen AS (SELECT gram, if(k < 2, bare_in, stop_in) AS inside FROM each)
SELECT gram, sum(if(inside = 1, 1, 0)) AS n_inside, sum(if(inside = -1, 1, 0)) AS n_end FROM seen WHERE inside <> 0 GROUP BY gram
"""
#: The last words of each text without marks of omission and broken mark-up.
_ENDS = r"""
WITH last AS (SELECT key, source, field, line, h AS line_id, trim(regexp_replace(title, '[\\s\\p{{Z}}]+', ' ')) AS title FROM {lines} WHERE final),
marked AS (SELECT key, source, field, line_id, line, coalesce(line = title, false) AS is_title, endswith(line, '�') OR (contains(line, '&') AND line RLIKE '&[A-Za-z]{{1,8}}$') OR (contains(line, '<') AND line RLIKE '<[A-Za-z/!][^<>]*$') AS broken,
  substring(line, -1, 1) = '…' OR substring(line, -3, 3) IN ('...', '[…]') OR substring(line, -5, 5) = '[...]' AS omitted FROM last),
plain AS (SELECT *, split(substring_index(if(broken OR omitted, regexp_replace(line, '\\s*(�+|&[A-Za-z]{{1,8}}|<[A-Za-z/!][^<>]*|\\[…\\]|\\[[.]{{3}}\\]|…|[.]{{3}})$', ''), line), ' ', -4), ' ') AS t FROM marked),
words AS (SELECT *, coalesce(try_element_at(t, -4), '^') AS z, coalesce(try_element_at(t, -3), '^') AS a, coalesce(try_element_at(t, -2), '^') AS b, try_element_at(t, -1) AS c FROM plain),
bare AS (SELECT *, if(rtrim('.,;:!?…"”“»«', c) = '', c, rtrim('.,;:!?…"”“»«', c)) AS w, if(rtrim('.,;:!?…"”“»«', b) = '', b, rtrim('.,;:!?…"”“»«', b)) AS v FROM words)
SELECT key, source, field, line_id, broken, omitted, is_title, c = '' AS empty, c RLIKE '[.!?]["”“»)]*$' AS stop, c RLIKE '[!?]' AS asks, c RLIKE '[)]$' AS bracket, c RLIKE '^[„«“(\\[]+$' AS opened,
  line RLIKE '^\\p{{L}}{{2,12}}: \\p{{Lu}}' AND line RLIKE ', \\p{{Lu}}[^ ,]* \\p{{Lu}}[^ ,]*$' AS cast, w,
  array(xxhash64('B3', a, b, w), xxhash64('B2', b, w), xxhash64('B3', z, a, v), xxhash64('E3', a, b, c), xxhash64('E1', c)) AS grams
FROM bare
"""
#: The grams of each last line, once, with how many other ends of the same articles have the same last words.
_OWN = """
WITH each AS (SELECT DISTINCT key, line_id FROM {ends}), many AS (SELECT key FROM each GROUP BY key HAVING count(*) > 1), some AS (SELECT each.* FROM each JOIN many ON each.key = many.key),
last AS (SELECT line_id, posexplode(grams) AS (k, gram) FROM (SELECT line_id, any_value(grams) AS grams FROM {ends} GROUP BY line_id)),
pairs AS (SELECT DISTINCT x.line_id, y.line_id AS other FROM some x JOIN some y ON x.key = y.key AND x.line_id <> y.line_id),
same AS (SELECT p.line_id, x.k, count(*) AS n_own FROM pairs p JOIN last x ON x.line_id = p.line_id JOIN last y ON y.line_id = p.other AND y.k = x.k AND y.gram = x.gram WHERE x.k <> 2 GROUP BY p.line_id, x.k)
SELECT last.*, coalesce(n_own, 0) AS n_own FROM last LEFT JOIN same ON same.line_id = last.line_id AND same.k = last.k
"""
#: Words as they are written, each once with its occurrences: what it is bare is found out once, not wherever it stands.
_SPELLINGS = """
SELECT c, ends, final, count(*) AS n FROM {cells} GROUP BY c, ends, final
"""
#: Words with their occurrences inside and at ends.
_VOCABULARY = """
SELECT ltrim('"„“”«»(', w) AS word, sum(if(bare_in = 1, n, 0)) AS b1_in, sum(if(bare_in = -1, n, 0)) AS b1_end FROM {words} GROUP BY 1
"""
#: How often longer words begin so.
_LONGER = """
SELECT start, sum(b1_in) AS n_longer FROM (SELECT explode(transform(sequence(1, length(word) - 1), i -> substring(word, 1, i))) AS start, b1_in FROM {vocabulary} WHERE length(word) > 1 AND b1_in > 0) GROUP BY start
"""
_JUDGED = f"""
WITH found AS (SELECT line_id, k, coalesce(n_inside, 0) AS n_inside, greatest(coalesce(n_end, 0) - 1 - n_own, 0) AS n_else FROM {{own}} o LEFT JOIN {{counts}} c ON c.gram = o.gram),
known AS (SELECT line_id AS known_id, max(if(k = 0, n_inside, 0)) AS b3_in, max(if(k = 0, n_else, 0)) AS b3_end, max(if(k = 1, n_inside, 0)) AS b2_in, max(if(k = 1, n_else, 0)) AS b2_end,
  max(if(k = 2, n_inside, 0)) AS before_in, max(if(k = 3, n_inside, 0)) AS e3_in, max(if(k = 3, n_else, 0)) AS e3_end, max(if(k = 4, n_inside, 0)) AS e1_in, max(if(k = 4, n_else, 0)) AS e1_end FROM found GROUP BY line_id),
wide AS (SELECT DISTINCT key, source, field, broken, omitted, is_title, empty, stop, asks, bracket, opened, cast, w, known.* FROM {{ends}} e JOIN known ON known_id = line_id),
judged AS (SELECT wide.*, coalesce(n_longer, 0) AS n_longer, coalesce(v.b1_in, 0) AS b1_in, greatest(coalesce(v.b1_end, 0) - 1, 0) AS b1_end FROM wide LEFT JOIN {{longer}} l ON l.start = ltrim('"„“”«»(', w) LEFT JOIN {{vocabulary}} v ON v.word = ltrim('"„“”«»(', w))
SELECT key, source, field, CASE
  WHEN broken THEN 'cut: mark-up' WHEN empty OR is_title THEN 'whole: headline'
  WHEN opened THEN 'cut: opening mark'
  WHEN stop AND asks THEN 'whole: sentence'
  WHEN stop AND e3_in + e3_end >= {STOP_LEAST} THEN if(e3_end <= {STOP_SHARE} * (e3_in + e3_end), 'cut: trigram with stop', 'whole: sentence')
  WHEN stop THEN if(e1_in + e1_end >= {STOP_LEAST} AND e1_end <= {STOP_SHARE} * (e1_in + e1_end), 'cut: word with stop', 'whole: sentence')
  WHEN NOT omitted AND (cast OR bracket) THEN 'whole: list or bracket'
  WHEN b3_in = 0 AND b3_end >= {LEAST} THEN if(before_in > 2 * (b3_end + 1), 'cut: trigram before', 'whole: trigram')
  WHEN b3_in + b3_end >= {LEAST} THEN if(b3_end <= {BARE_SHARE} * (b3_in + b3_end), 'cut: trigram', 'whole: trigram')
  WHEN n_longer >= {LEAST} AND n_longer > b1_in + b1_end THEN 'cut: within a word'
  WHEN b2_in + b2_end >= {LEAST} THEN if(b2_end <= {BARE_SHARE} * (b2_in + b2_end), 'cut: bigram', 'whole: bigram')
  WHEN b1_in + b1_end >= {LEAST} THEN if(b1_end <= {BARE_SHARE} * (b1_in + b1_end), 'cut: word', 'whole: word')
  WHEN before_in >= {LEAST} THEN 'cut: trigram before'
  ELSE 'whole: no evidence' END AS reason
FROM judged
"""


def distinct_lines(lines: DataFrame) -> DataFrame:
    """(line, final) of the distinct lines, final if one of them is. Only lines whose hash (``h``, if it is given) stands more than once are gathered; the others are read where they stand."""
    hashed = lines.select("line", "final", F.col("h") if "h" in lines.columns else F.xxhash64("line").alias("h"))
    again = cut(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    repeated = written(join_dimension(hashed, again, "h", "left_semi").groupBy("line").agg(F.max("final").alias("final")))
    return join_dimension(hashed, again, "h", "left_anti").select("line", "final").unionByName(repeated)


def judged_fields(articles: DataFrame, fields: tuple[str, ...] = ("full_text", "summary"), key: str = "id") -> DataFrame:
    """(key, source, field, reason) of every field that has a text of its own; reasons begin with ``cut`` or ``whole``.

    Page lines are left out first (they may follow a text that broke off), then marks of omission. A
    text is cut if its last three words stand often inside texts and almost never at an end in that
    form: without a full stop against ends of texts, with one (abbreviations) against ends of lines,
    there also by the last word alone. Where three words are too rare to judge by, the last two
    decide, then the last one; before them, a last word that is rarer than longer words that begin with
    it was cut within; one that nothing is known of is cut if the three words before it mostly go on. What ends
    in words that nothing is known of is whole, as are lists of names after a label and closed
    brackets. A text that ends in broken mark-up or an opening mark is cut. A field equal to the row's title is a headline and whole.

    Null, empty and blank fields have no row; rows repeated are judged as one. Counts cover every
    distinct line once, so that copies do not vouch for one another; ends of a text leave out its own
    and those of other fields of its articles. They are aggregated map-side on hashes of words.
    """
    spark = articles.sparkSession
    lines = written(own_lines(articles, fields, key).select("key", "source", F.when(F.col("final"), F.col("title")).alias("title"), "field", "line", F.xxhash64("line").alias("h"), "final"))
    cells = spark.sql(_CELLS, lines=distinct_lines(lines))
    counts = cut(spark.sql(_GRAMS, words=spark.sql(_WORDS, cells=cells)))
    vocabulary = written(spark.sql(_VOCABULARY, words=spark.sql(_WORDS, cells=spark.sql(_SPELLINGS, cells=cells))))
    ends = written(spark.sql(_ENDS, lines=lines))
    return spark.sql(_JUDGED, ends=ends, counts=counts, own=spark.sql(_OWN, ends=ends), vocabulary=vocabulary, longer=spark.sql(_LONGER, vocabulary=vocabulary)).withColumnRenamed("key", key)


def truncated_fields(articles: DataFrame, fields: tuple[str, ...] = ("full_text", "summary"), key: str = "id") -> DataFrame:
    """(key, source, field, truncated) of every field that has a text of its own, see ``judged_fields``."""
    return judged_fields(articles, fields, key).select(key, "source", "field", F.col("reason").startswith("cut").alias("truncated"))


def truncation_rates(articles: DataFrame, fields: tuple[str, ...] = ("full_text", "summary")) -> DataFrame:
    """(source, field, n_texts, n_truncated, rate) by source; null is a source of its own here."""
    by = truncated_fields(articles, fields).groupBy("source", "field")
    return by.agg(F.count("*").alias("n_texts"), F.count_if("truncated").alias("n_truncated")).withColumn("rate", F.round(F.col("n_truncated") / F.col("n_texts"), 6))
