"""Reference SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from fluxfold.llm.line_dedup import MIN_CHARS
from fluxfold.llm.quality_rules import RULES, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"


def _rule(name: str) -> str:
    rule = next(r for r in RULES if r.name == name)
    over, under = (x.strip() for x in rule.measure.split("/"))
    tests = [f"{over}::DOUBLE / {under} >= {rule.low}"] if rule.low is not None else []
    tests += [f"{over}::DOUBLE / {under} <= {rule.high}"] if rule.high is not None else []
    return f"({under} = 0 OR ({' AND '.join(tests)}))"


def quality_sql(source: str = "documents") -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS.split()))
    rules = " AND ".join(_rule(r.name) for r in RULES)
    return f"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM {source}
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), counts AS (
  SELECT doc_id, len(words) AS n_words, len(list_aggregate(words, 'string_agg', '')) AS chars,
         len(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
         len(list_filter(words, lambda w: rtrim(lower(w), '.,;:!?') IN ({stop}))) AS n_stop_words,
         len(list_filter(words, lambda w: regexp_matches(w, '^\\p{{Lu}}{{2,}}\\P{{L}}*$'))) AS n_upper_words,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[\\x20\\x09-\\x0D]*[-*•]'))) AS n_bullet_lines
  FROM split
), measures AS (
  SELECT c.*, coalesce(chars, 0) AS word_chars, coalesce(r.n_repeat_words, 0) AS n_repeat_words
  FROM counts c LEFT JOIN repeated r USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {rules} AS kept
FROM judged"""


def line_sql(source: str = "documents") -> str:
    """Every window of lines with enough characters and no shorter one inside, against all earlier."""
    return f"""
WITH lines AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {source}
), line AS (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM lines
), placed AS (
  SELECT doc_id, p, lines[p] AS line,
         sum(length(lines[p]) + 1) OVER (PARTITION BY doc_id ORDER BY p) AS upto,
         length(lines[p]) + 1 AS chars
  FROM line
), spans AS (
  SELECT a.doc_id, a.p AS s, b.p AS e, a.upto - a.chars AS before_s, b.upto AS upto_e,
         a.chars AS chars_s, b.chars AS chars_e
  FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.p BETWEEN a.p AND a.p + {MIN_CHARS}
  WHERE b.upto - (a.upto - a.chars) >= {MIN_CHARS}
    AND (b.upto - b.chars - (a.upto - a.chars) < {MIN_CHARS} OR b.upto - a.upto < {MIN_CHARS})
), windows AS (
  SELECT s.*, array_to_string(list_slice(l.lines, s.s, s.e), chr(10)) AS text
  FROM spans s JOIN lines l USING (doc_id)
), later AS (
  SELECT doc_id, s, e FROM (
    SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, s) AS k FROM windows)
  WHERE k > 1
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS p FROM later
), runs AS (
  SELECT doc_id, count(*) AS n_removed,
         count(*) FILTER (p - 1 NOT IN (SELECT r.p FROM removed r WHERE r.doc_id = removed.doc_id)) AS n_runs
  FROM removed GROUP BY doc_id
), kept AS (
  SELECT line.doc_id, string_agg(lines[p], chr(10) ORDER BY p) AS text
  FROM line ANTI JOIN removed ON line.doc_id = removed.doc_id AND line.p = removed.p GROUP BY line.doc_id
)
SELECT l.doc_id, len(l.lines) AS n_lines, coalesce(r.n_removed, 0) AS n_removed,
       coalesce(r.n_runs, 0) AS n_runs, md5(coalesce(k.text, '')) AS kept_md5
FROM lines l LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)"""


def near_sql(size: int = 4, percent: int = 80, source: str = "documents") -> str:
    """Every pair that shares a shingle, then the closure of the links."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{_WORD}') AS words
  FROM {source}
), starts AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - {size - 1}, 1) + 1)) AS i
  FROM split WHERE len(words) > 0
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + {size - 1}), ' ') AS gram FROM starts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM grams x JOIN grams y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= {percent} * (x.n + y.n - k)
), reach AS (
  SELECT doc_id, doc_id AS other FROM {source}
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
), lowest AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN sizes USING (doc_id)"""


def substring_sql(n_bytes: int = 50, source: str = "documents") -> str:
    """Every window of every text, written in hexadecimal digits."""
    return f"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS digits FROM {source}
), chunks AS (
  SELECT doc_id, k, substr(digits, 800 * k + 1, 800 + {2 * n_bytes - 2}) AS part
  FROM (SELECT doc_id, digits, unnest(range(0, len(digits) // 800 + 1)) AS k FROM texts)
), windows AS (
  SELECT doc_id, 400 * k + o AS p, substr(part, 2 * o + 1, {2 * n_bytes}) AS w
  FROM (SELECT doc_id, k, part, unnest(range(0, least(400, len(part) // 2 - {n_bytes - 1}))) AS o FROM chunks)
), lowest AS (
  SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT doc_id, p FROM windows JOIN lowest USING (w) WHERE first < doc_id
), runs AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {n_bytes} THEN 1 ELSE 0 END AS fresh
        FROM hits)
), spans AS (
  SELECT doc_id, min(p) AS s, max(p) + {n_bytes} AS e FROM runs GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS s, s AS e FROM spans
  UNION ALL
  SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(digits, 2 * s + 1, 2 * (coalesce(e, len(digits) // 2) - s)), '' ORDER BY s) AS digits
  FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id
), totals AS (
  SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT t.doc_id, len(t.digits) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k.digits, t.digits))) AS kept_sha256
FROM texts t LEFT JOIN totals USING (doc_id) LEFT JOIN kept k ON k.doc_id = t.doc_id"""


def spelling_sql(source: str = "documents") -> str:
    """Checksums by table, near words by the words they become without one letter."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END,
                          i::BIGINT) AS c
    FROM range(256) r(i))
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[a-zÀ-ÿ]+')) AS run
  FROM {source}
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM found WHERE length(run) >= 7 GROUP BY ALL
), coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
           lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
                          ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)] END)) AS bytes
  FROM runs
), summed AS (
  SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT),
                     4294967295::BIGINT) AS h
  FROM coded, crc
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, n
  FROM summed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), without AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT DISTINCT x.word AS a, y.word AS b, y.n
  FROM without x JOIN without y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION
  SELECT x.word, y.word, y.n FROM without x JOIN words y ON x.rest = y.word
  UNION
  SELECT y.word, x.word, x.n FROM without x JOIN words y ON x.rest = y.word
), best AS (
  SELECT a, count(*) AS n_near, max(n) AS top, min(b) FILTER (k = 1) AS form
  FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM near) GROUP BY a
), forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near,
         CASE WHEN top >= 10 * n THEN form END AS form, CASE WHEN top >= 10 * n THEN top END AS form_n
  FROM words LEFT JOIN best ON word = a
), walk AS (
  SELECT word, word AS at FROM forms
  UNION
  SELECT w.word, f.form FROM walk w JOIN forms f ON f.word = w.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN walk w USING (word) JOIN forms last ON last.word = w.at WHERE last.form IS NULL"""


def phrase_sql(min_count: int = 100, top: int = 2000, source: str = "documents") -> str:
    """Every phrase of one to five words of every piece."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM {source}
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces
), starts AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM split
), found AS (
  SELECT lang, k AS size, array_to_string(list_slice(words, i, i + k - 1), ' ') AS phrase
  FROM starts, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(words)
), counted AS (
  SELECT lang, size, phrase, count(*) AS f FROM found GROUP BY ALL HAVING count(*) >= {min_count}
), totals AS (
  SELECT lang, sum(len(words))::BIGINT AS n FROM split GROUP BY lang
), many AS (
  SELECT lang, phrase, size, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE size > 1
), inside AS (
  SELECT lang, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase, max(a) AS top
  FROM many, (SELECT unnest([1, 2, 3, 4]) AS s), (SELECT unnest([2, 3, 4]) AS k)
  WHERE s + k - 1 <= size AND k < size GROUP BY ALL
), whole AS (
  SELECT many.* FROM many LEFT JOIN inside USING (lang, phrase) WHERE top IS NULL OR 100 * top < 100 * a
), cuts AS (
  SELECT m.lang, m.phrase, m.a, m.k, x.f AS l, y.f AS r, t.n,
         ((1000::HUGEINT * m.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM whole) m
  JOIN counted x ON x.lang = m.lang AND x.phrase = array_to_string(list_slice(m.w, 1, m.k), ' ')
  JOIN counted y ON y.lang = m.lang AND y.phrase = array_to_string(list_slice(m.w, m.k + 1, m.size), ' ')
  JOIN totals t ON t.lang = m.lang
), lowest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM cuts) WHERE o = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {top}"""


def join_sql(size: int = 4, percent: int = 85, source: str = "documents") -> str:
    """The closure of the links at this threshold, without the choice of a document to keep."""
    return f"SELECT doc_id, n_shingles, component_id FROM ({near_sql(size, percent, source)})"
