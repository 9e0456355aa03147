"""What the queries over the training-data operators return, in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

WORD = r"[^\x20\x09-\x0D]+"
#: Lower-cases A-Z alone.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def crc_ctes(strings: str) -> str:
    """CTEs up to ``crcs`` (text, text_crc32): unsigned crc32 of the UTF-8 bytes of the distinct ``text`` of a query, by the reflected polynomial 0xEDB88320."""
    return f"""crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), hexed AS (SELECT text, hex(encode(text)) AS h FROM (SELECT DISTINCT text FROM ({strings}))),
bytes_of AS (SELECT text, list_transform(regexp_extract_all(h, '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM hexed),
crcs AS (SELECT text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM bytes_of, crc_table)"""


CRC32_CTES = crc_ctes("SELECT coalesce(text, '') AS text FROM documents")

#: Two documents of a similarity of 0.8 share one of the rarest shingles of each (as many as may be missing, and one more).
OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}') AS words FROM documents),
spelt AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 2 THEN list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) ELSE [words[1]] END) AS shingle
  FROM w WHERE len(words) > 0
), s AS (SELECT DISTINCT doc_id, hash(shingle) AS h, shingle FROM spelt),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
ranked AS (
  SELECT doc_id, shingle, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, shingle) AS r
  FROM s JOIN (SELECT shingle, count(*) AS df FROM s GROUP BY shingle) USING (shingle) JOIN sizes USING (doc_id)
), rare AS (SELECT doc_id, shingle, n FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM rare x JOIN rare y USING (shingle)
  WHERE x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
), counted AS (
  SELECT a, b, na, nb, count(*) AS shared FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.h = x.h AND y.shingle = x.shingle GROUP BY ALL
), links AS (SELECT a, b FROM counted WHERE 100 * shared >= 80 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least_of AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(low, doc_id)) AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""



def op2(rules: Sequence[tuple[str, str]], longest: int) -> str:
    """Rules from the longest on; names are split by going through their ends with the least costs so far, and back from the last end."""
    fits = []
    for text, said in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = text.partition("/")
        fits.append((f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '/{rest}') THEN", text, said))
    case = lambda i: "CASE " + " ".join(f"{f[0]} '{f[i]}'" for f in fits) + " END"
    return rf"""
WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), u AS (SELECT page_id, host, path, {case(1)} AS rule, {case(2)} AS said, regexp_replace(path, '[0-9]+', '0', 'g') AS shape FROM parts),
shapes AS (SELECT host, shape, count(*) FILTER (WHERE said = 'allow') AS a, count(*) FILTER (WHERE said = 'block') AS b FROM u GROUP BY ALL),
spelt AS (SELECT unnest(regexp_split_to_array(lower(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g')), '[^\p{{L}}]+')) AS word FROM pages),
words AS (SELECT word, count(*) AS n FROM spelt WHERE length(word) BETWEEN 2 AND {longest} GROUP BY word),
total AS (SELECT CAST(coalesce(sum(n), 1) AS DOUBLE) AS t FROM words),
named AS (SELECT host, shape, a, b, unnest(regexp_split_to_array(host, '[^\p{{L}}]+')) AS name FROM shapes),
names AS (SELECT DISTINCT name FROM named WHERE name <> ''),
found AS (
  SELECT name, start, start + size AS stop, ln(t / n) AS cost FROM names, range(0, {longest}) x(start), range(1, {longest + 1}) y(size), total JOIN words ON word = substr(name, start + 1, size)
  WHERE start + size <= length(name) AND length(name) <= {longest}
), walk(name, stop, costs, backs) AS (
  SELECT name, CAST(0 AS BIGINT), [CAST(0 AS DOUBLE)], CAST([] AS BIGINT[]) FROM names WHERE length(name) <= {longest}
  UNION ALL
  SELECT name, stop + 1, list_append(costs, best.cost), list_append(backs, best.start) FROM (
    SELECT w.name, w.stop, w.costs, w.backs, min({{'cost': coalesce(w.costs[f.start + 1] + f.cost, w.costs[w.stop + 1] + (ln(t) + 10)), 'start': coalesce(f.start, w.stop)}}) AS best
    FROM walk w CROSS JOIN total LEFT JOIN (SELECT * FROM found UNION ALL SELECT name, NULL, unnest(range(1, length(name) + 1)), NULL FROM names) f ON f.name = w.name AND f.stop = w.stop + 1
    WHERE w.stop < length(w.name) GROUP BY w.name, w.stop, w.costs, w.backs
  )
), back(name, backs, stop, word) AS (
  SELECT name, backs, stop, CAST(NULL AS VARCHAR) FROM walk WHERE stop = length(name)
  UNION ALL
  SELECT name, backs, backs[stop], substr(name, backs[stop] + 1, stop - backs[stop]) FROM back WHERE stop > 0
), pieces AS (SELECT name, word FROM back WHERE word IS NOT NULL UNION ALL SELECT name, name FROM names WHERE length(name) > {longest}),
tokens AS (
  SELECT host, shape, a, b, word AS token FROM named JOIN pieces USING (name)
  UNION ALL SELECT host, shape, a, b, '/' || t FROM (SELECT host, shape, a, b, unnest(regexp_split_to_array(lower(shape), '[^\p{{L}}0]+')) AS t FROM shapes) WHERE t <> ''
), seen AS (SELECT token, sum(a) AS a, sum(b) AS b FROM tokens GROUP BY token),
sums AS (SELECT sum(a) AS sa, sum(b) AS sb, count(*) AS v FROM seen),
score AS (SELECT host, shape, sum(ln((s.b + 1) / (sb + v)) - ln((s.a + 1) / (sa + v))) AS score FROM tokens JOIN seen s USING (token), sums GROUP BY host, shape),
n AS (SELECT count(*) FILTER (WHERE said = 'allow') AS na, count(*) FILTER (WHERE said = 'block') AS nb FROM u)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN na > 0 AND nb > 0 AND coalesce(score, 0) + ln(nb / na) > 1e-9 THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN score USING (host, shape), n
"""


#: Texts are cut into overlapping pieces first, so that a window is taken from a short string.
OP4 = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, c * 500 AS begin_, substr(h, 1000 * c + 1, 1098) AS piece FROM t, unnest(range(0, CAST(len(h) // 1000 AS BIGINT) + 1)) AS u(c)),
windows AS (SELECT doc_id, begin_ + i AS p, substr(piece, 2 * i + 1, 100) AS win FROM pieces, unnest(range(0, least(500, len(piece) // 2 - 49))) AS u(i)),
gone AS (SELECT doc_id, p FROM windows JOIN (SELECT win, min(doc_id) AS low FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)) USING (win) WHERE doc_id > low),
lost AS (SELECT DISTINCT doc_id, p + k AS p FROM gone, unnest(range(0, 50)) AS u(k)),
runs AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE new) AS spans FROM (SELECT doc_id, p, coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) < p - 1, true) AS new FROM lost) GROUP BY doc_id),
bytes_of AS (SELECT doc_id, begin_ + i AS p, substr(piece, 2 * i + 1, 2) AS b FROM pieces, unnest(range(0, least(500, len(piece) // 2))) AS u(i) WHERE doc_id IN (SELECT doc_id FROM runs)),
kept AS (SELECT doc_id, string_agg(b, '' ORDER BY p) AS h FROM bytes_of ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(t.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(runs.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN runs.n IS NULL THEN t.h ELSE coalesce(kept.h, '') END)) AS kept_sha256
FROM t LEFT JOIN runs USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i : i + 49], ' ') AS win FROM w, unnest(range(1, len(words) - 48)) AS u(i)),
gone AS (SELECT doc_id, i FROM windows JOIN (SELECT win, min(doc_id) AS low FROM windows GROUP BY win HAVING min(doc_id) < max(doc_id)) USING (win) WHERE doc_id > low),
lost AS (SELECT DISTINCT doc_id, i + k AS i FROM gone, unnest(range(0, 50)) AS u(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w) ANTI JOIN lost USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id) USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op7(levels: Mapping[str, str], weights: Mapping[str, int], max_epochs: int, seed: int) -> str:
    """Budgets of each level by filling children from the smallest capacity over weight, then the prefix of each leaf's seeded order."""
    names, ctes = list(levels), []
    own = ", ".join(f"coalesce(CAST({e} AS VARCHAR), '') AS {c}" for c, e in levels.items())
    ctes.append(rf"docs AS (SELECT doc_id, {own}, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents)")
    ctes.append(f"leaves AS (SELECT {', '.join(names)}, CAST(sum(n_tokens) AS HUGEINT) AS supply FROM docs GROUP BY ALL)")
    ctes.append("b0 AS (SELECT CAST(sum(supply) AS HUGEINT) AS budget FROM leaves)")
    for k, name in enumerate(names, 1):
        path, parent = ", ".join(names[:k]), names[: k - 1]
        weight = " ".join(f"WHEN '{key.partition('=')[2]}' THEN {w}" for key, w in weights.items() if key.startswith(f"{name}="))
        weight = f"CASE {name} {weight} ELSE 1 END" if weight else "1"
        above = f"JOIN b{k - 1} USING ({', '.join(parent)})" if parent else "CROSS JOIN b0"
        by = f"PARTITION BY {', '.join(parent)} " if parent else ""
        ctes.append(f"n{k} AS (SELECT *, capacity / weight AS ratio FROM (SELECT {path}, CAST(sum(supply) * {max_epochs} AS HUGEINT) AS capacity, CAST({weight} AS HUGEINT) AS weight FROM leaves GROUP BY {path}) {above})")
        order = f"ORDER BY ratio, {name}"
        ctes.append(
            f"o{k} AS (SELECT *, CAST(budget - coalesce(sum(capacity) OVER ({by}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS rest_here,"
            f" CAST(sum(weight) OVER ({by}{order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS still FROM n{k})"
        )
        ctes.append(f"f{k} AS (SELECT *, min(CASE WHEN rest_here * weight >= capacity * still THEN 1 ELSE 0 END) OVER ({by}{order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM o{k})")
        part = f"PARTITION BY {', '.join([*parent, 'filled'])}"
        ctes.append(
            f"s{k} AS (SELECT *, CAST(budget - coalesce(sum(capacity) FILTER (WHERE filled = 1) OVER ({by or ''}), 0) AS HUGEINT) AS rest, CAST(sum(weight) OVER ({part}) AS HUGEINT) AS open_,"
            f" CAST(sum(weight) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS HUGEINT) AS upto FROM f{k})"
        )
        ctes.append(f"b{k} AS (SELECT {path}, CASE WHEN filled = 1 THEN capacity ELSE rest * upto // open_ - rest * (upto - weight) // open_ END AS budget FROM s{k})")
    keys = ", ".join(names)
    ctes.append(f"ends AS (SELECT {keys}, supply, CAST(budget AS BIGINT) AS leaf_budget, CASE WHEN supply > 0 THEN CAST(budget // supply AS BIGINT) ELSE 0 END AS whole FROM leaves JOIN b{len(names)} USING ({keys}))")
    ctes.append(f"ranked AS (SELECT *, substr(md5(concat_ws('|', '{seed}', {keys}, whole, coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 16) AS rank FROM docs JOIN ends USING ({keys}))")
    ctes.append(f"summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY rank, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM ranked)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, {keys}, n_tokens, leaf_budget, CAST(whole + CASE WHEN run <= leaf_budget - whole * supply AND n_tokens > 0 THEN 1 ELSE 0 END AS INTEGER) AS epochs FROM summed"


def op8(shards: int, salts: int) -> str:
    """The search goes through one state at a time: bounds of the capacity, the one tried (-1: none yet), the end of its last shard, the shards it has used."""
    on = f"tried >= 0 AND done < total AND used < {shards}"
    return f"""
WITH RECURSIVE {CRC32_CTES},
d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS print FROM documents),
sums AS (SELECT print, min(doc_id) AS low, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY print),
groups_ AS (SELECT *, CAST(sum(size) OVER (ORDER BY low NULLS FIRST, print) AS BIGINT) AS stop FROM sums),
search(low, high, tried, done, used, total) AS (
  SELECT greatest((total + {shards - 1}) // {shards}, most), (total + {shards - 1}) // {shards} + most, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), 0, total FROM (SELECT max(stop) AS total, max(size) AS most FROM groups_)
  UNION ALL
  SELECT CASE WHEN tried >= 0 AND done < total AND used = {shards} THEN tried + 1 ELSE low END, CASE WHEN tried >= 0 AND done = total THEN tried ELSE high END,
         CASE WHEN tried < 0 THEN (low + high) // 2 WHEN {on} THEN tried ELSE -1 END,
         CASE WHEN {on} THEN (SELECT max(g.stop) FROM groups_ g WHERE g.stop <= least(total, done + tried)) ELSE 0 END, CASE WHEN {on} THEN used + 1 ELSE 0 END, total
  FROM search WHERE tried >= 0 OR low < high
),
best AS (SELECT min(high) AS capacity, any_value(total) AS total FROM search),
cuts(shard, done) AS (
  SELECT 0, CAST(0 AS BIGINT) FROM best WHERE total IS NOT NULL
  UNION ALL SELECT shard + 1, (SELECT max(g.stop) FROM groups_ g WHERE g.stop <= least(total, done + capacity)) FROM cuts, best WHERE done < total AND shard < {shards}
),
placed AS (SELECT print, low, (SELECT max(shard) FROM cuts WHERE cuts.done <= groups_.stop - groups_.size AND cuts.done < (SELECT total FROM best)) AS shard FROM groups_)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY low NULLS FIRST, print, coalesce((doc_id % {salts} + {salts}) % {salts}, 0), doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN placed USING (print) JOIN crcs USING (text)
"""

OP6 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

OP9 = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS win FROM w, unnest(range(1, len(words) - 1)) AS u(i)
), repeated AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, unnest([0, 1, 2]) AS u(k) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), base AS (
  SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS failed FROM judged GROUP BY source
), moments AS (
  SELECT least(greatest(avg(failed / n), 1e-6), 1 - 1e-6) AS mean, coalesce(var_samp(failed / n), 0) AS var FROM hosts
), prior AS (
  SELECT mean, least(greatest(CASE WHEN var > 0 THEN mean * (1 - mean) / var - 1 ELSE 1e6 END, 1.0), 1e6) AS strength FROM moments
), rates AS (
  SELECT source, (failed + mean * strength) / (n + strength) AS rate FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= 0.5 AS kept
FROM judged JOIN rates ON judged.source IS NOT DISTINCT FROM rates.source
"""


#: A place belongs to a stretch of period p if its six words come again p words later; six are equal in every stretch that a run needs.
OP11 = rf"""
WITH {crc_ctes("SELECT CAST(doc_id AS VARCHAR) AS text FROM documents WHERE doc_id IS NOT NULL")},
split AS (SELECT doc_id, text_crc32 AS h, regexp_extract_all(coalesce(d.text, ''), '{WORD}') AS w FROM documents d LEFT JOIN crcs ON crcs.text = CAST(doc_id AS VARCHAR)),
sized AS (SELECT doc_id, h, w, len(w) AS n, CASE WHEN len(w) > 0 THEN h // 10 % len(w) END AS a FROM split),
t AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + h // 10 % 8)) + 1] END) ELSE w END AS w FROM sized
), grams AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 6], ' ') AS g FROM t, unnest(range(0, n - 5)) AS u(i)),
places AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
stretches AS (SELECT doc_id, p, min(i) AS s, count(*) + 5 + p AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM places) GROUP BY doc_id, p, island),
long_ AS (SELECT * FROM stretches WHERE size >= greatest(12, 2 * p)),
runs AS (SELECT * FROM long_ x WHERE NOT EXISTS (SELECT 1 FROM long_ y WHERE y.doc_id = x.doc_id AND y.p < x.p AND x.p % y.p = 0 AND y.s <= x.s AND x.s + x.size <= y.s + y.size)),
told AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'s': s, 'size': size, 'p': p}}, {{'a': -size, 'b': s, 'c': p}}) AS best, sha256(string_agg(s || ',' || size || ',' || p || chr(10), '' ORDER BY s, p)) AS runs_sha256 FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(range(s + p, s + size)) AS u(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT doc_id, unnest(w) AS word, unnest(range(0, n)) AS i FROM t) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.size AS length, best.p AS period, 1000 * best.size // best.p AS exponent_milli, coalesce(runs_sha256, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN told USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op12(terms: Sequence[Sequence], phrases: Sequence[tuple[Sequence[str], str]], rarest: int, least: float) -> str:
    """terms: (label, words, key phrases as words); phrases: (words, label). All starts of all templates are weighed."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({t}, {y}, {text(w)})" for t, (_, words, _) in enumerate(terms) for y, w in enumerate(words))
    labels = ", ".join(f"({t}, {text(label)}, {len(words)})" for t, (label, words, _) in enumerate(terms))
    keys = ", ".join(f"({t}, {k}, {len(key)}, {text(' '.join(key))})" for t, (*_, own) in enumerate(terms) for k, key in enumerate(own))
    spoken = ", ".join(f"({len(words)}, {text(' '.join(words))}, {text(label)})" for words, label in phrases)
    return rf"""
WITH tpl(t, y, word) AS (VALUES {rows}), named(t, label, size) AS (VALUES {labels}), keys(t, k, size, phrase) AS (VALUES {keys}), phrases(size, phrase, label) AS (VALUES {spoken}),
docs AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spelt AS (SELECT d, i, w[i + 1] AS word, w FROM docs, unnest(range(0, len(w))) AS u(i)),
known AS (SELECT d, i, word FROM spelt WHERE word IN (SELECT word FROM tpl)),
weights AS (SELECT word, ln(1 + ((SELECT count(*) FROM docs) + 1) / (coalesce(files, 0) + 1)) AS weight FROM (SELECT DISTINCT word FROM tpl) LEFT JOIN (SELECT word, count(DISTINCT d) AS files FROM known GROUP BY word) USING (word)),
total AS (SELECT t, sum(weight) AS total, count(DISTINCT word) AS kinds FROM tpl JOIN weights USING (word) GROUP BY t),
asked AS (
  SELECT d, t, word FROM (SELECT DISTINCT d, t, word, weight FROM known JOIN tpl USING (word) JOIN weights USING (word)) QUALIFY row_number() OVER (PARTITION BY d, t ORDER BY weight DESC, word) <= {rarest}
), starts AS (SELECT d, t, i - y AS s FROM asked JOIN known USING (d, word) JOIN tpl USING (t, word) JOIN total USING (t) GROUP BY d, t, i - y HAVING count(DISTINCT word) >= least(2, any_value(kinds))),
weighed AS (SELECT d, t, s, round(sum(weight) / any_value(total), 6) AS share FROM starts JOIN tpl USING (t) JOIN known USING (d, word) JOIN weights USING (word) JOIN total USING (t) WHERE i = s + y GROUP BY d, t, s),
found AS (
  SELECT d, label, share FROM weighed x JOIN named USING (t) JOIN docs USING (d)
  WHERE share >= {least} AND NOT EXISTS (SELECT 1 FROM keys WHERE keys.t = x.t AND strpos(' ' || array_to_string(w[greatest(s, 0) + 1 : s + named.size], ' ') || ' ', ' ' || phrase || ' ') = 0)
), base AS (SELECT d, i, label FROM spelt JOIN phrases ON word = split_part(phrase, ' ', 1) AND array_to_string(w[i + 1 : i + phrases.size], ' ') = phrase),
told AS (SELECT d, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY d),
both_ AS (SELECT d, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT d, label FROM base UNION ALL SELECT d, label FROM found) GROUP BY d),
best AS (SELECT d, max(share) AS score FROM found GROUP BY d)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM docs LEFT JOIN told USING (d) LEFT JOIN both_ USING (d) LEFT JOIN best USING (d)
"""


#: A node is the keys of its turns, joined; those in its subtree begin with it.
OP13 = rf"""
WITH {crc_ctes("SELECT CAST(conv_id AS VARCHAR) AS text FROM conversations WHERE conv_id IS NOT NULL")},
keyed AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'n': n}} ORDER BY turn NULLS FIRST, k, n) AS turns FROM keyed GROUP BY conv_id),
built AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1 : text_crc32 % 4], []), c.turns[text_crc32 % 4 + 1 : ]) AS turns
  FROM own c JOIN crcs ON crcs.text = CAST(c.conv_id AS VARCHAR) LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20
), members AS (
  SELECT conv_id, d AS depth, array_to_string(list_transform(turns[1 : d], lambda x: x.k), '') AS path, CASE WHEN d > 0 THEN turns[d].n ELSE 0 END AS n, d = len(turns) AS ends FROM built, unnest(range(0, len(turns) + 1)) AS u(d)
), nodes AS (
  SELECT depth, path, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY depth, path
), kids AS (SELECT depth - 1 AS depth, left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (depth, path)),
below AS (SELECT path, depth AS own, unnest(range(0, depth + 1)) AS depth, n_convs, n, n_children FROM full_),
sums AS (SELECT depth, left(path, 32 * depth) AS path, CAST(count(*) FILTER (WHERE n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * n) AS BIGINT) AS saved_tokens FROM below GROUP BY ALL)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
FROM full_ f JOIN sums USING (depth, path) LEFT JOIN nodes up ON f.depth > 0 AND up.depth = f.depth - 1 AND up.path = left(f.path, 32 * (f.depth - 1))
"""
