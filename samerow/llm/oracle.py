"""SQL that DuckDB runs on the same tables, written without the operators' code."""

from __future__ import annotations

OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text, coalesce(role = 'system', false) AS is_system
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND NOT is_system
), each AS (
  SELECT t.*, perspective, coalesce(speaker = perspective, false) AS mine
  FROM t JOIN people ON t.conv_id IS NOT DISTINCT FROM people.conv_id
), named AS (
  SELECT *,
    CASE WHEN is_system THEN 'system' WHEN mine THEN 'assistant' ELSE 'user' END AS shown,
    CASE WHEN NOT is_system AND NOT mine THEN speaker END AS name
  FROM each
), headed AS (
  SELECT *, '<|' || shown || coalesce(' name=' || name, '') || '|>' || chr(10) AS head FROM named
), rendered AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, (sum(length(rendered)) OVER (
    PARTITION BY conv_id, perspective
    ORDER BY turn NULLS FIRST, speaker NULLS FIRST, text
    ROWS UNBOUNDED PRECEDING) - length(rendered))::BIGINT AS start
  FROM rendered
)
SELECT conv_id, perspective, turn, shown AS role, name, rendered, start,
  start + length(rendered) AS "end",
  CASE WHEN shown = 'assistant' THEN start + length(head) ELSE start + length(rendered) END AS mask_start,
  start + length(rendered) - CASE WHEN shown = 'assistant' THEN 1 ELSE 0 END AS mask_end
FROM placed
"""

OP6 = """
SELECT doc_id,
  max(doc_id) OVER same AS keep_id,
  count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# Votes of the six rules on the measures: conditions for very bad, bad and good.
_VOTES = [
    ("4 * n_symbols > n_words", "10 * n_symbols > n_words", "20 * n_symbols <= n_words"),
    (
        "word_chars < 2 * n_words OR word_chars > 15 * n_words",
        "word_chars < 3 * n_words OR word_chars > 10 * n_words",
        "2 * word_chars >= 7 * n_words AND word_chars <= 8 * n_words",
    ),
    ("5 * n_dup_lines > 3 * n_lines", "5 * n_dup_lines > 2 * n_lines", "10 * n_dup_lines <= n_lines"),
    ("5 * n_repeat_words > 3 * n_words", "5 * n_repeat_words > 2 * n_words", "10 * n_repeat_words <= n_words"),
    ("5 * n_capitals > 3 * word_chars", "5 * n_capitals > 2 * word_chars", "5 * n_capitals <= word_chars"),
    ("10 * n_shouts > 3 * n_words", "10 * n_shouts > n_words", "50 * n_shouts <= n_words"),
]


def op5(rounds: int = 30) -> str:
    """Measures by unnesting words, and one CTE for each round of expectation-maximisation.

    ``s0`` to ``s6`` are the shares of good texts and of those bad by each rule; ``a`` and ``c`` are how often a rule votes bad
    on good texts and on texts that are bad by another rule.
    """
    m = len(_VOTES)
    rules, classes = range(m), range(m + 1)
    votes = ",\n    ".join(
        f"CASE WHEN {x} THEN -2 WHEN {b} THEN -1 WHEN {g} THEN 1 ELSE 0 END AS v{j}" for j, (x, b, g) in enumerate(_VOTES)
    )
    columns = ", ".join(f"v{j}" for j in rules)

    def vote(c: int, j: int) -> str:
        if c == j + 1:
            good, bad, very = "0.1::DOUBLE", "0.4::DOUBLE", "0.5::DOUBLE"
        elif c == 0:
            good, bad, very = f"(1 - a{j})", f"(a{j} * 0.95::DOUBLE)", f"(a{j} * 0.05::DOUBLE)"
        else:
            good, bad, very = f"(1 - c{j})", f"(c{j} * 0.4::DOUBLE / 0.9)", f"(c{j} * 0.5::DOUBLE / 0.9)"
        return f"CASE v{j} WHEN 1 THEN {good} WHEN -1 THEN {bad} WHEN -2 THEN {very} ELSE 1 END"

    def joint(c: int) -> str:
        return f"s{c}" + "".join(f" * {vote(c, j)}" for j in rules)

    # Beliefs before the first round; later they count as 50 texts.
    shares = ["0.8::DOUBLE", *[f"(0.2::DOUBLE / {m})"] * m]
    rates = [*[(f"a{j}", "0.002::DOUBLE", "w0", j) for j in rules]]
    for j in rules:
        others = " + ".join(f"w{c}" for c in classes if c not in (0, j + 1))
        rates.append((f"c{j}", "0.05::DOUBLE", f"({others})", j))
    start = ", ".join([*[f"{shares[c]} AS s{c}" for c in classes], *[f"{belief} AS {name}" for name, belief, _, _ in rates]])
    steps = [f"model0 AS MATERIALIZED (SELECT {start})"]
    for k in range(rounds):
        joints = ", ".join(f"{joint(c)} AS j{c}" for c in classes)
        total = " + ".join(f"j{c}" for c in classes)
        weights = ", ".join(f"n * j{c} / ({total}) AS w{c}" for c in classes)
        out = [f"(coalesce(sum(w{c}), 0) + 50 * {shares[c]}) / (coalesce(sum(n), 0) + 50) AS s{c}" for c in classes]
        for name, belief, weight, j in rates:
            bad = f"coalesce(sum({weight}) FILTER (WHERE v{j} < 0), 0)"
            cast = f"coalesce(sum({weight}) FILTER (WHERE v{j} <> 0), 0)"
            out.append(f"({bad} + 50 * {belief}) / ({cast} + 50) AS {name}")
        steps.append(
            f"model{k + 1} AS MATERIALIZED (SELECT {', '.join(out)} FROM (SELECT *, {weights} FROM"
            f" (SELECT {columns}, n, {joints} FROM patterns, model{k})))"
        )
    chain = ",\n".join(steps)
    total = " + ".join(f"({joint(c)})" for c in classes)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d)
), windows AS (
  SELECT id, i, word || ' ' || lead(word, 1) OVER a || ' ' || lead(word, 2) OVER a AS three
  FROM w WINDOW a AS (PARTITION BY id ORDER BY i)
), twice AS (
  SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, three) AS n FROM windows WHERE three IS NOT NULL) WHERE n > 1
), covered AS (
  SELECT id, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY id
), lines AS (
  SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY id
), measured AS (
  SELECT d.doc_id,
    coalesce(c.n, 0) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
    (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouts
  FROM d
  LEFT JOIN (SELECT id, count(*) AS n FROM w GROUP BY id) c USING (id)
  LEFT JOIN covered USING (id) LEFT JOIN lines USING (id)
), voted AS MATERIALIZED (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {votes}
  FROM measured
), patterns AS MATERIALIZED (
  SELECT {columns}, count(*) AS n FROM voted GROUP BY {columns}
), {chain}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND ({joint(0)}) / ({total}) >= 0.5 AS kept
FROM voted, model{rounds}
"""

# Sources at their limit are those that an equal share of the rest would pass, in the order of limit by weight.
OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, source, left(md5('1:' || doc_id), 16) AS rnd,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), weighed AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT AS cycle, 3.0::DOUBLE * source_size AS most FROM sums
), filled AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][cycle + 1] AS weight FROM weighed
), ordered AS (
  SELECT *, sum(most) OVER o - most AS most_before, sum(weight) OVER o - weight AS weight_before,
    sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
  FROM filled WINDOW o AS (ORDER BY most / weight, source NULLS LAST)
), marked AS (
  SELECT *, most * (all_weights - weight_before) <= (total - most_before) * weight AS is_full FROM ordered
), rest AS (
  SELECT any_value(total) - coalesce(sum(most) FILTER (WHERE is_full), 0) AS words,
    any_value(all_weights) - coalesce(sum(weight) FILTER (WHERE is_full), 0) AS weights
  FROM marked
), goals AS (
  SELECT source, source_size, cycle,
    CASE WHEN is_full THEN most ELSE words::DOUBLE * weight / CASE WHEN weights = 0 THEN 1 ELSE weights END END AS target
  FROM marked, rest
), known AS (
  SELECT d.*, source_size, cycle, target,
    (sum(size) OVER (PARTITION BY d.source ORDER BY rnd NULLS FIRST, doc_id NULLS FIRST, size, id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS first
  FROM d JOIN goals ON d.source IS NOT DISTINCT FROM goals.source
), copies AS (
  SELECT id, doc_id, rnd, cycle, target, copy, copy * source_size + first AS start,
    least(size, floor(target)::BIGINT - copy * source_size - first) AS words
  FROM known, (SELECT unnest([0, 1, 2]) AS copy)
  WHERE size > 0 AND copy * source_size + first < floor(target)::BIGINT
), middles AS (
  SELECT *, (2 * start + words)::DOUBLE / (2.0::DOUBLE * target) AS middle FROM copies
), timed AS (
  -- Weights over time go from 7.5 to 2.5, stay at 2, go from 0.5 to 1.5.
  SELECT *, CASE cycle
    WHEN 0 THEN 2.0::DOUBLE * (middle * 5.0::DOUBLE) / (7.5::DOUBLE + sqrt(56.25::DOUBLE + -10.0::DOUBLE * (middle * 5.0::DOUBLE)))
    WHEN 1 THEN 2.0::DOUBLE * (middle * 2.0::DOUBLE) / 4.0::DOUBLE
    ELSE 2.0::DOUBLE * middle / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * middle)) END AS time
  FROM middles
), placed AS (
  SELECT *, row_number() OVER (ORDER BY time, rnd NULLS FIRST, doc_id NULLS FIRST, copy, words, id) - 1 AS place FROM timed
), summed AS (
  SELECT id, sum(words)::BIGINT AS taken, count(*) AS n_copies, min(place) AS first_place FROM placed GROUP BY id
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, coalesce(n_copies, 0) AS n_copies, first_place
FROM known LEFT JOIN summed USING (id)
"""

OP12 = r"""
WITH folded AS (
  SELECT row_number() OVER () AS id, doc_id,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), held AS (
  SELECT id, doc_id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM folded
), asked AS (
  SELECT item, item_id, unnest(terms) AS term FROM (
    SELECT row_number() OVER () AS item, item_id,
      regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM benchmark)
), times AS (
  SELECT item, item_id, term, count(*) AS times FROM asked GROUP BY ALL
), lengths AS (
  SELECT id, count(*) AS n FROM held GROUP BY id
), totals AS (
  SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM lengths
), postings AS (
  SELECT id, doc_id, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM times) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, totals GROUP BY term, docs
), impacts AS (
  SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS impact
  FROM postings JOIN lengths USING (id) JOIN weights USING (term), totals
), scored AS (
  SELECT item, item_id, id, doc_id, sum(times * impact)::BIGINT AS score
  FROM times JOIN impacts USING (term) GROUP BY ALL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, id)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

# CRC-32 bit by bit: each byte is mixed in, then eight steps shift it out.
OP13 = r"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), steps AS (
  SELECT c, list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''),
    lambda ch : [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS ops
  FROM (SELECT DISTINCT c FROM t)
), convs AS (
  SELECT c, xor(list_reduce(ops, lambda a, x : CASE WHEN x >= 0 THEN xor(a, x)
    WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 6 AS h
  FROM steps
), rebuilt AS (
  SELECT convs.c, 0 AS part, pos, role, text FROM convs JOIN t ON t.c = convs.c - convs.c % 100 AND pos <= h
  UNION ALL SELECT t.c, 1, pos, role, text FROM t JOIN convs ON t.c = convs.c AND pos > h
), prefixes AS (
  SELECT c, length(text) AS len, row_number() OVER o AS d,
    string_agg(md5(length(role)::VARCHAR || ':' || role || text), '') OVER (o ROWS UNBOUNDED PRECEDING) AS p
  FROM rebuilt WINDOW o AS (PARTITION BY c ORDER BY part, pos)
), members AS (
  SELECT c, 0 AS len, 0 AS d, '' AS p FROM convs UNION ALL SELECT c, len, d, p FROM prefixes
), sized AS (
  SELECT *, max(d) OVER (PARTITION BY c) AS last FROM members
), nodes AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n, any_value(len) AS len,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '')) AS ends
  FROM sized GROUP BY p, d
), children AS (
  SELECT p, left(p, 32 * (d - 1)) AS parent FROM nodes WHERE d > 0
), counted AS (
  SELECT nodes.*, coalesce(k, 0) AS n_children
  FROM nodes LEFT JOIN (SELECT parent, count(*) AS k FROM children GROUP BY parent) x ON nodes.p = x.parent
), below AS (
  SELECT v.p, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, sum((u.n - 1) * u.len)::BIGINT AS saved_tokens
  FROM counted v JOIN counted u ON u.d >= v.d AND left(u.p, 32 * v.d) = v.p GROUP BY v.p
)
SELECT v.conv_id, v.d::BIGINT AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, v.n_children, n_leaves, saved_tokens,
  v.ends AS ends_sha256
FROM counted v JOIN below ON below.p = v.p LEFT JOIN counted up ON v.d > 0 AND up.p = left(v.p, 32 * (v.d - 1))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_perspective_rotation": OP3,
        "op5_weak_supervision": op5(),
        "op6_digest_tree": OP6,
        "op11_curriculum_mix": OP11,
        "op12_interval_search": OP12,
        "op13_double_array_trie": OP13,
    }
