"""SQL for DuckDB of operators whose definition it can say: n-gram models, repeated substrings."""

from __future__ import annotations

#: Start and end marks: characters for private use, which no text holds.
START, END = "\ue000", "\ue001"


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    byte = "lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], list_transform(string_split({text}, ''), lambda z: CAST(ord(z) AS BIGINT))), {byte}), 4294967295)"


def kneser_ney(order: int, tokens: str) -> str:
    """Tables of an interpolated modified Kneser-Ney model of ``tk`` (rid, pos, w, train), which ``tokens`` makes.

    pt: (rid, w, raw, p) of every token; sm: (n, v) of the training tokens.
    """
    before = [f"p{k}" for k in range(order - 1, 0, -1)]  # farthest first
    parts = [tokens, "tg AS (SELECT rid, pos, w, train" + "".join(f", coalesce(lag(w, {k}) OVER (PARTITION BY rid ORDER BY pos), '{START}') AS p{k}" for k in range(1, order)) + " FROM tk)"]
    parts += ["rw AS (SELECT w, count(*) AS raw FROM tk WHERE train GROUP BY 1)", "sm AS (SELECT coalesce(sum(raw), 0)::BIGINT AS n, count(*) AS v FROM rw)"]
    for level in range(order, 0, -1):
        own = ", ".join([*before[order - level :], "w"])
        source = "tg WHERE train" if level == order else f"c{level + 1}"
        parts.append(f"c{level} AS (SELECT {own}, count(*) AS n FROM {source} GROUP BY ALL)")
        parts.append(f"k{level} AS (SELECT count(*) FILTER (WHERE n = 1) AS n1, count(*) FILTER (WHERE n = 2) AS n2, count(*) FILTER (WHERE n = 3) AS n3, count(*) FILTER (WHERE n = 4) AS n4, count(*) FILTER (WHERE n >= 3) AS m3, coalesce(sum(n), 0)::DOUBLE AS total FROM c{level})")
        cut = lambda k: f"CASE WHEN n1 = 0 THEN {(0.5, 0.75, 1.0)[k - 1]}::DOUBLE ELSE least(greatest(CASE WHEN n{k} > 0 THEN {k} - {k + 1} * (n1 / (n1 + 2.0 * n2)) * n{k + 1} / n{k} ELSE {k / 2} END, 0.05), {k - 0.05}::DOUBLE) END"
        parts.append(f"d{level} AS (SELECT *, {cut(1)} AS e1, {cut(2)} AS e2, {cut(3)} AS e3 FROM k{level})")
        if level > 1:
            context = ", ".join(before[order - level :])
            parts.append(f"x{level} AS (SELECT {context}, count(*) FILTER (WHERE n = 1) AS x1, count(*) FILTER (WHERE n = 2) AS x2, count(*) FILTER (WHERE n >= 3) AS x3, sum(n)::DOUBLE AS xs FROM c{level} GROUP BY ALL)")
    less = lambda n: f"greatest(coalesce({n}, 0) - CASE WHEN coalesce({n}, 0) = 0 THEN 0 WHEN {n} = 1 THEN e1 WHEN {n} = 2 THEN e2 ELSE e3 END, 0)"
    parts.append(f"q1 AS (SELECT tg.*, coalesce(rw.raw, 0) AS raw, CASE WHEN total > 0 THEN ({less('c1.n')} + (e1 * n1 + e2 * n2 + e3 * m3) / (sm.v + 1)) / total ELSE 1.0::DOUBLE / (sm.v + 1) END AS p FROM tg LEFT JOIN c1 USING (w) LEFT JOIN rw USING (w), d1, sm)")
    for level in range(2, order + 1):
        own, context = ", ".join([*before[order - level :], "w"]), ", ".join(before[order - level :])
        parts.append(f"q{level} AS (SELECT q.* EXCLUDE (p), CASE WHEN xs > 0 THEN ({less(f'c{level}.n')} + (e1 * x1 + e2 * x2 + e3 * x3) * p) / xs ELSE p END AS p FROM q{level - 1} q LEFT JOIN c{level} USING ({own}) LEFT JOIN x{level} USING ({context}), d{level})")
    parts.append(f"pt AS (SELECT rid, w, raw, p FROM q{order})")
    return ",\n".join(parts)


def lm_scoring(order: int) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    tokens = f"""rows_ AS (SELECT row_number() OVER () AS rid, doc_id, {crc32('CAST(doc_id AS VARCHAR)')} % 10 = 0 AS held_out, list_append({words}, '{END}') AS l FROM documents),
tk AS (SELECT rid, w, pos, NOT held_out AS train FROM (SELECT rid, held_out, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM rows_))"""
    return f"""WITH {kneser_ney(order, tokens)}
SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM rows_ JOIN (
  SELECT rid, count(*) AS n_tokens, count(*) FILTER (WHERE raw > 0) AS n_known, any_value(sm.n) AS train_tokens, round(sum(log10((raw + 0.1) / (sm.n + 0.1 * (sm.v + 1)))), 6) AS base_score, round(sum(log10(p)), 6) AS score FROM pt, sm GROUP BY 1) USING (rid)
"""


def quality(order: int, quantile: float, folds: int) -> str:
    tokens = f"""rows_ AS (SELECT row_number() OVER () AS rid, doc_id, lang, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS trusted, {crc32('CAST(doc_id AS VARCHAR)')} % {folds} <> 0 AS fold, list_append(string_split(coalesce(text, ''), ''), '{END}') AS l0 FROM documents),
tk AS (SELECT rid, w, pos, train FROM (SELECT rid, trusted AND fold AS train, unnest(list_filter(l0, lambda z: z <> '')) AS w, generate_subscripts(list_filter(l0, lambda z: z <> ''), 1) AS pos FROM rows_))"""
    return f"""WITH {kneser_ney(order, tokens)},
sc AS (SELECT rid, count(*) - 1 AS n_characters, round(pow(10.0, -sum(log10(p)) / count(*)), 3) AS perplexity FROM pt GROUP BY 1),
rs AS (SELECT * FROM rows_ JOIN sc USING (rid)),
lm AS (SELECT lang, coalesce(quantile_disc(perplexity, {quantile}) FILTER (WHERE trusted AND NOT fold), quantile_disc(perplexity, {quantile}) FILTER (WHERE trusted), quantile_disc(perplexity, {quantile})) AS threshold FROM rs GROUP BY 1)
SELECT doc_id, rs.lang, trusted, n_characters, perplexity, threshold, perplexity <= threshold AS kept FROM rs JOIN lm ON lm.lang IS NOT DISTINCT FROM rs.lang
"""


def suffix_dedup(span: int) -> str:
    return f"""WITH b AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS t, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT rid, i, md5(t[i:i + {span - 1}]) AS h FROM (SELECT rid, t, unnest(range(1, n - {span - 2})) AS i FROM b WHERE n >= {span})),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + {span} THEN 0 ELSE 1 END AS fresh FROM r),
s AS (SELECT rid, min(i) AS a, max(i) + {span} AS z FROM (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM g) GROUP BY rid, k),
k AS (SELECT rid, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a)::BIGINT AS gone, count(*) AS spans FROM s GROUP BY 1)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(CASE WHEN spans IS NULL THEN t ELSE from_hex(array_to_string(list_transform(range(1, spans + 2), lambda j: hex(CASE WHEN j = 1 THEN t[1:a[1] - 1] WHEN j = spans + 1 THEN t[z[spans]:n] ELSE t[z[j - 1]:a[j] - 1] END)), '')) END) AS kept_sha256
FROM b LEFT JOIN k USING (rid)
"""


#: Cuts by units, both forms, and the text rebuilt from the output by the places of the marks.
FILL_MIDDLE = r"""WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(x, k, 8) AS BIGINT)) AS h FROM d),
k AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (SELECT *, array_to_string(u[1:lo], '') AS prefix, array_to_string(u[lo + 1:hi], '') AS middle, array_to_string(u[hi + 1:n], '') AS suffix FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
w AS (SELECT *, instr(output, '<P>') AS ip, instr(output, '<S>') AS iss, instr(output, '<M>') AS im, length(output) AS z FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, iss - 4) || substr(output, im + 3, z) || substr(output, iss + 3, im - iss - 3)
    ELSE substr(output, ip + 3, im - ip - 3) || substr(output, im + 3, z) || substr(output, 4, ip - 4) END) AS restored_sha256
FROM w
"""


def conversation_repair() -> str:
    """Cheapest edits by recursion from the last row: (cost, audit) to go from each of the four states."""
    white = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    best = lambda *arcs: "list_min([" + ", ".join(f"{{'c': {c}, 'a': {a}}}" for c, a in arcs) + "])"
    near, bad = 1000000, "(CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END)"
    own = []
    # states: nothing, system, user, assistant kept last; the state after s, u, a or none, and after a user or assistant row
    for q, (steps, forward) in enumerate([({"s": 1, "u": 2}, 2), ({"u": 2}, 2), ({"a": 3}, 3), ({"u": 2}, 2)]):
        arcs = [(f"f{q}.c + 2", f"'D' || f{q}.a")]
        kept = " ".join(f"WHEN '{i}' THEN f{s}" for i, s in steps.items())
        on = lambda part: f"CASE WHEN fault IN ('blank', 'duplicate') THEN {near} ELSE {part} END"
        arcs.append((on(f"coalesce((CASE left(role, 1) {kept} END).c, {near}) + {bad}"), f"'K' || coalesce((CASE left(role, 1) {kept} END).a, '')"))
        arcs.append((on(f"f{forward}.c + 1 + {bad}"), f"'R' || f{forward}.a"))
        own.append(f"{best(*arcs)} AS g{q}")
    closed = lambda g: [best((f"{g}{q}.c", f"{g}{q}.a"), (f"{g}{n}.c + 5", f"'I' || {g}{n}.a"), *(((f"{g}{m}.c + 10", f"'II' || {g}{m}.a"),) if q < 2 else ())) for q, n, m in ((0, 2, 3), (1, 2, 3), (2, 3, 2), (3, 2, 3))]
    fs = ", ".join(f"{c} AS f{q}" for q, c in enumerate(closed("g")))
    return f"""WITH RECURSIVE r0 AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS lot FROM conversations
), r1 AS (
  SELECT conv_id, turn, CASE WHEN lot = 4 THEN 'user' ELSE role END AS role, CASE WHEN lot = 1 THEN '' WHEN lot = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE lot WHEN 0 THEN []::INT[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM r0)
), r2 AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, rtrim(text, {white}) AS bare
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS pos FROM r1)
), r3 AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'ok' ELSE 'truncated' END AS fault,
    pos > 1 AND left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AS illegal, count(*) OVER (PARTITION BY conv_id) AS n FROM r2
), c AS (SELECT DISTINCT conv_id FROM r0),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE illegal) AS illegal FROM r3 GROUP BY 1
), ends AS (SELECT {{'c': 0, 'a': ''}} AS g0, {{'c': {near}, 'a': ''}} AS g1, {{'c': {near}, 'a': ''}} AS g2, {{'c': 0, 'a': ''}} AS g3),
f AS (
  SELECT conv_id, n + 1 AS pos, {fs} FROM (SELECT DISTINCT conv_id, n FROM r3), ends
  UNION ALL
  SELECT conv_id, pos, {fs} FROM (SELECT r3.conv_id, r3.pos, {', '.join(own)} FROM f JOIN r3 ON r3.conv_id IS NOT DISTINCT FROM f.conv_id AND r3.pos = f.pos - 1)
), a AS (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM f WHERE pos = 1),
e AS (SELECT conv_id, k, audit[k] AS letter, k - len(replace(replace(replace(audit[1:k], 'K', ''), 'R', ''), 'D', '')) AS pos, len(replace(audit[1:k], 'D', '')) AS place FROM (SELECT *, unnest(range(1, len(audit) + 1)) AS k FROM a)),
l AS (
  SELECT e.*, r3.role, r3.text, bool_or(e.letter = 'K' AND left(r3.role, 1) = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM e LEFT JOIN r3 ON e.letter <> 'I' AND r3.conv_id IS NOT DISTINCT FROM e.conv_id AND r3.pos = e.pos WHERE letter <> 'D'
), t AS (
  SELECT conv_id, string_agg((CASE WHEN letter = 'K' THEN role WHEN (place - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS repaired FROM l GROUP BY 1
)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
  CAST(coalesce(a.cost, 0) AS BIGINT) AS cost, coalesce(a.audit, '') AS audit, sha256(coalesce(t.repaired, '')) AS repaired_sha256
FROM c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM c.conv_id
"""
