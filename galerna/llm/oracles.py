"""The queries that SQL can express, in SQL for DuckDB: plain definitions, without the operators' methods."""

from __future__ import annotations

from galerna.llm import licenses, quality, warc

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def op2() -> str:
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    base = " UNION ALL ".join(
        f"SELECT r, i - 1 AS place, '{label}' AS label FROM places WHERE w[i : i + {len(p.split()) - 1}] = {_list(p.split())}"
        for p, label in licenses.PHRASES
    )
    method = " UNION ALL ".join(
        f"""SELECT r, size, s, {k} AS t, '{t.label}' AS label, {len(set(t.text.split()))} AS n, len(list_intersect(b, {_list(sorted(set(t.text.split())))})) AS o
        FROM blocks WHERE size = {licenses.block_words(t)}"""
        for k, t in enumerate(licenses.TEMPLATES)
    )
    sizes = ", ".join(str(x) for x in sorted(set(map(licenses.block_words, licenses.TEMPLATES))))
    pairs = ", ".join(f"({t}, {u})" for t, u in licenses.rivals(licenses.TEMPLATES))
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{words}') AS w FROM documents),
    places AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs),
    base AS ({base}),
    sized AS (SELECT unnest([{sizes}]) AS size),
    blocks AS (SELECT r, size, s, list_slice(w, s + 1, s + size) AS b FROM (SELECT r, w, size, unnest(range(0, len(w), size // 2)) AS s FROM docs, sized)),
    method AS MATERIALIZED (SELECT *, o::DOUBLE / n AS score FROM ({method}) WHERE o::DOUBLE / n >= {licenses.THRESHOLD} - 1e-9),
    rivals(t, u) AS (VALUES {pairs}),
    explained AS (SELECT DISTINCT m.r, m.size, m.s, m.t FROM method m JOIN rivals v ON v.t = m.t JOIN method x ON x.t = v.u AND x.r = m.r AND x.s <= m.s AND x.s + x.size >= m.s + m.size
      WHERE x.o * m.n > m.o * x.n OR (x.o * m.n = m.o * x.n AND x.n > m.n)),
    named AS (SELECT m.r, m.label FROM method m ANTI JOIN explained e ON e.r = m.r AND e.size = m.size AND e.s = m.s AND e.t = m.t),
    b AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
    a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM base UNION ALL SELECT r, label FROM named) GROUP BY r),
    m AS (SELECT r, max(score) AS score FROM method GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
      CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
    FROM docs LEFT JOIN b USING (r) LEFT JOIN a USING (r) LEFT JOIN m USING (r)"""


def op6() -> str:
    record = (
        r"concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10), "
        r"'Content-Length: ', strlen(coalesce(html, ''))::VARCHAR, chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10))"
    )
    assert warc.LEVELS > 0
    return f"""SELECT page_id, strlen({record})::BIGINT AS length, sha256({record}) AS record_sha256,
      CASE WHEN page_id % 101 = 7 THEN 'missing' WHEN page_id % 97 = 13 THEN 'changed' ELSE 'intact' END AS status FROM pages"""


def op8(rules, shout: str) -> str:
    cases = [
        (r, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')")
        for r in sorted(rules, key=lambda r: (-len(r.name), r.name))
    ]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r.name}'" for r, c in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{r.verdict}'" for r, c in cases)
    verdict += " WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END"
    host = _LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")
    return f"""WITH p AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(contains(html, '{shout}'), false) AS shouts FROM pages),
    listed AS (SELECT host FROM p GROUP BY host HAVING 2 * count(*) FILTER (shouts) >= count(*))
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM p"""


def op9() -> str:
    q = quality
    return rf"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    windows AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) > 2)),
    repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
    covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
    lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM docs),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(regexp_extract_all(t, '[!?]')) AS n_marks, len(regexp_extract_all(t, '[A-Z]')) AS n_capitals
      FROM docs JOIN lines USING (r) LEFT JOIN covered USING (r)),
    b AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR n_symbols > {q.MAX_SYMBOLS_PER_WORD} * n_words OR n_marks > {q.MAX_MARKS_PER_WORD} * n_words OR n_capitals > {q.MAX_CAPITALS} * word_chars
        OR n_dup_lines > {q.MAX_DUPLICATE_LINES} * n_lines OR word_chars > {q.MAX_CHARS_PER_WORD} * n_words) AS kept
    FROM b"""


def op12() -> str:
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    five = ", ".join(f"{letters} l{k}(x{k})" for k in range(1, 6))
    differ = " AND ".join(f"x{i} <> x{k}" for i in range(1, 6) for k in range(i + 1, 6))
    return rf"""
    WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
    firsts AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
    marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    flags AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS failed
      FROM docs JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
    orders AS (SELECT x1 || x2 || x3 || x4 || x5 AS filter_order FROM {five} WHERE {differ}),
    steps AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1 : step - 1] AS before FROM orders, range(1, 6) s(step)),
    grouped AS (SELECT part, failed, count(*) AS n, count_if(good) AS goods, count_if(toxic) AS toxics FROM flags GROUP BY part, failed),
    met AS (SELECT part, filter_order, step, letter, n, goods, toxics, failed, contains(failed, letter) AS fails,
        len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AND failed <> '' AND before <> '' AS gone FROM grouped, steps),
    counted AS (SELECT part, filter_order, step, letter,
        sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN NOT gone AND fails THEN goods ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxics ELSE 0 END) AS toxic_lost
      FROM met GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
      unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
      (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM counted"""
