"""SQL for DuckDB of the queries that SQL can express on whole tables: licences and near duplicates."""

from __future__ import annotations

from loomline.llm import licenses

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_scan() -> str:
    """Base phrases and mandatory phrases wherever they stand, templates weighed by the words that stand in place."""
    base = ", ".join(f"({_text(' '.join(phrase))}, {_text(label)})" for phrase, label in licenses.BASE.items())
    templates = ", ".join(f"({k}, {_text(label)}, {_text(phrase)}, {_text(text)})" for k, (label, phrase, text) in enumerate(licenses.TEMPLATES))
    return rf"""WITH worded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
  base(phrase, label) AS (VALUES {base}), template(t, label, phrase, body) AS (VALUES {templates}),
  split AS (SELECT t, label, string_split(phrase, ' ') AS phrase, string_split(body, ' ') AS body FROM template),
  joined AS (SELECT r, doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM worded),
  vocabulary AS (SELECT DISTINCT unnest(body) AS word FROM split),
  df AS (SELECT word, count(*) AS n FROM (SELECT r, unnest(list_distinct(words)) AS word FROM worded) x SEMI JOIN vocabulary USING (word) GROUP BY 1),
  idf AS (SELECT word, ln(((SELECT count(*) FROM documents) + 1) / (coalesce(n, 0) + 0.5::DOUBLE)) AS w FROM vocabulary LEFT JOIN df USING (word)),
  weighed AS (SELECT t, label, phrase, body, list(w ORDER BY j) AS weights FROM (SELECT t, label, phrase, body, unnest(range(1, len(body) + 1)) AS j FROM split) s JOIN idf ON idf.word = s.body[s.j] GROUP BY ALL),
  places AS (SELECT r, label, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i:i + len(string_split(phrase, ' ')) - 1] = string_split(phrase, ' '))) - 1 AS start
    FROM joined JOIN base ON contains(line, ' ' || phrase || ' ')),
  based AS (SELECT r, count(*) AS n, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS names FROM places GROUP BY r),
  inside AS (SELECT t, label, body, weights, list_filter(range(1, len(body) + 1), lambda i: body[i:i + len(phrase) - 1] = phrase)[1] AS key_at, phrase FROM weighed),
  stand AS (SELECT r, words, label, body, weights, unnest(list_filter(range(1, len(words) + 1), lambda i: words[i:i + len(phrase) - 1] = phrase)) - key_at AS o
    FROM joined JOIN inside ON contains(line, ' ' || array_to_string(phrase, ' ') || ' ')),
  share AS (SELECT r, label, list_sum(list_transform(range(1, len(body) + 1), lambda j: CASE WHEN o + j >= 1 AND words[o + j] = body[j] THEN weights[j] ELSE 0 END)) / list_sum(weights) AS share FROM stand),
  own AS (SELECT r, list(DISTINCT label) AS names, max(share) AS share FROM share GROUP BY r)
  SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(b.names), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(b.names, o.names))), ','), '') AS labels,
    least(1.0::DOUBLE, greatest(coalesce(o.share, 0), CASE WHEN n > 0 THEN 0.5::DOUBLE ELSE 0 END)) AS score
  FROM worded LEFT JOIN based b USING (r) LEFT JOIN own o USING (r)"""


def near_duplicates() -> str:
    """Every pair's common shingles, and who is reached by links."""
    return rf"""WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingle AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
  size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY 1),
  pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
  link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
  way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, way.b FROM reach r JOIN way ON way.a = r.c)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, c = d.doc_id AS kept
  FROM documents d LEFT JOIN size USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM reach GROUP BY 1) r ON r.doc_id = d.doc_id"""


ORACLE = {"op5_license_scan": license_scan(), "op7_minhash": near_duplicates()}
