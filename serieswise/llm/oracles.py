"""SQL twins, for DuckDB, of the queries that SQL can express."""

from __future__ import annotations

from serieswise.llm import weak_rules as W

BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def _step() -> str:
    """One EM step over the pattern table: class masses and votes are window sums."""
    classes, rules = range(len(W.KINDS) + 1), range(len(W.RULES))
    logs = []
    for c in classes:
        mass = f"sum(n * q{c}) OVER ()"
        parts = [f"ln({mass} + {W.PRIOR})"]
        for j in rules:
            own = W.OWN if c and j in W.KINDS[c - 1][1] else 0.0
            hits = f"sum(n * q{c}) OVER (PARTITION BY v{j})"
            parts.append(f"ln(({hits} + {W.PRIOR} + CASE WHEN v{j} = -1 THEN {own} ELSE 0 END) / ({mass} + {3 * W.PRIOR + own}))")
        logs.append(" + ".join(parts) + f" AS g{c}")
    votes = ", ".join(f"v{j}" for j in rules)
    new = ", ".join(f"1 / ({' + '.join(f'exp(g{d} - g{c})' for d in classes)}) AS q{c}" for c in classes)
    return f"SELECT step + 1, {votes}, n, {new} FROM (SELECT step, {votes}, n, {', '.join(logs)} FROM em WHERE step < {W.STEPS})"


def weak_rules_sql() -> str:
    votes = [f"CASE WHEN {junk} THEN -1 WHEN {keep} THEN 1 ELSE 0 END AS v{j}" for j, (_, junk, keep) in enumerate(W.RULES)]
    names = ", ".join(f"v{j}" for j in range(len(W.RULES)))
    hit = [f"CAST({' OR '.join(f'v{j} = -1' for j in rules)} AS INTEGER)" for _, rules in W.KINDS]
    found = " + ".join(hit)
    # cast: a decimal start would round every later step
    start = [f"CAST(CASE WHEN {found} = 0 THEN {1 - W.START} ELSE {W.START} END AS DOUBLE) AS q0"] + [
        f"CAST(CASE WHEN {found} = 0 THEN {W.START / len(W.KINDS)} ELSE {1 - W.START} * {h} / greatest({found}, 1) END AS DOUBLE) AS q{c}"
        for c, h in enumerate(hit, 1)
    ]
    count = lambda chars: f"length(t) - length(regexp_replace(t, '[{chars}]', '', 'g'))"
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls FROM d),
windows AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM windows) WHERE c > 1),
covered AS (SELECT rid, CAST(sum(least(8, i - prev)) AS BIGINT) AS n
            FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS prev FROM again) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, {count('#*$%&|<>')} AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             len(regexp_extract_all(t || ' ', '[#*$%&|<>]{BLANK}')) AS n_marked,
             length(t) - length(regexp_replace(t, '\p{{Lu}}{{2,}}', '', 'g')) AS n_capitals,
             {count('!')} AS n_marks, {count('.?')} AS n_stops, len(list_distinct(ws)) AS n_distinct
      FROM w LEFT JOIN covered ON covered.rid = w.rid),
voted AS (SELECT *, n_words < {W.MIN_WORDS} OR 100 * n_repeat_words > {W.MAX_REPEAT_PERCENT} * n_words AS base_failed, {', '.join(votes)} FROM m),
em AS (
  SELECT 0 AS step, {names}, n, {', '.join(start)} FROM (SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL)
  UNION ALL {_step()}),
judged AS (SELECT * FROM em WHERE step = {W.STEPS})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND q0 >= 0.5 AS kept, round(q0, 4) AS posterior
FROM voted JOIN judged USING ({names})"""


FIXITY_SQL = """
WITH r AS (
  SELECT coalesce(CAST(floor(page_id / 1000) AS BIGINT), -1) AS file, page_id AS record_id,
         concat('WARC/1.0', crlf, 'WARC-Type: response', crlf, 'WARC-Record-ID: <urn:page:', coalesce(CAST(page_id AS VARCHAR), ''), '>', crlf,
                'WARC-Target-URI: ', coalesce(url, ''), crlf, 'Content-Length: ', CAST(strlen(coalesce(html, '')) AS VARCHAR), crlf, crlf,
                coalesce(html, ''), crlf, crlf) AS bytes
  FROM pages, (SELECT chr(13) || chr(10) AS crlf)),
p AS (
  SELECT file, record_id, strlen(bytes) AS length, sha256(bytes) AS expected_digest, bytes,
         CAST(coalesce(sum(strlen(bytes)) OVER (PARTITION BY file ORDER BY record_id, sha256(bytes)
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position
  FROM r)
SELECT file, min(position) AS position, record_id, length, 'missing' AS status, expected_digest, NULL AS actual_digest, count(*) AS copies
FROM p WHERE record_id % 193 = 7 GROUP BY ALL
UNION ALL
SELECT file, min(position), record_id, length, 'altered', expected_digest, sha256('X' || bytes[2:]), count(*)
FROM p WHERE record_id % 97 = 13 AND record_id % 193 <> 7 GROUP BY file, record_id, length, expected_digest, bytes"""

FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

#: Levels that the SQL twin of the manifest can tell: 8 ** 7 rows a group, 8 ** 3 groups.
ROW_LEVELS, GROUP_LEVELS = 7, 3


def _merkle_levels(name: str, levels: int) -> str:
    """Levels of `name`0 (g, place, total, digest), and of each node the digests left and right of it in its run."""
    parts = []
    for j in range(levels):
        run = "OVER (PARTITION BY g, place // 8 ORDER BY place ROWS BETWEEN"
        parts.append(f"""
{name}{j + 1} AS (
  SELECT g, place // 8 AS place, any_value(total) AS total, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM {name}{j} WHERE total > {8**j} GROUP BY g, place // 8
  UNION ALL SELECT g, place, total, digest FROM {name}{j} WHERE total <= {8**j}),
{name}_beside{j} AS (
  SELECT g, place, coalesce(string_agg(digest, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(digest, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM {name}{j} WHERE total > {8**j})""")
    return ",".join(parts)


def _merkle_fold(name: str, start: str, levels: int, node: str) -> str:
    """Fold and proof of the rows of `start` (g, place, fold, proof, ...) level by level."""
    parts, before = [], start
    for j in range(levels):
        parts.append(f"""
{name}_fold{j} AS (
  SELECT f.* REPLACE (CASE WHEN b.lft IS NULL THEN fold ELSE sha256(b.lft || fold || b.rgt) END AS fold, proof || coalesce(b.lft || b.rgt, '') AS proof)
  FROM {before} f LEFT JOIN {name}_beside{j} b ON b.g = f.{node[0]} AND b.place = f.{node[1]} // {8**j})""")
        before = f"{name}_fold{j}"
    return ",".join(parts)


def manifest_sql() -> str:
    bits = "lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    chars = "list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {chars}), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), {bits})), 4294967295)"
    cell = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    leaf = lambda text: "sha256(" + " || ".join(cell(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT *, CASE WHEN {crc} % 3 = 0 THEN {lowered} ELSE text END AS claimed FROM documents),
l AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {leaf('text')} AS leaf, {leaf('claimed')} AS claimed_leaf FROM d),
rows0 AS (SELECT doc_id, g, leaf, claimed_leaf, leaf AS digest, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                 count(*) OVER (PARTITION BY g) AS total FROM l),
{_merkle_levels('rows', ROW_LEVELS)},
subroots0 AS (SELECT 0 AS g, g AS place, count(*) OVER () AS total, digest FROM rows{ROW_LEVELS}),
{_merkle_levels('subroots', GROUP_LEVELS)},
proofs AS (SELECT doc_id, g, place, leaf, claimed_leaf AS fold, '' AS proof, 0 AS one FROM rows0),
{_merkle_fold('rows', 'proofs', ROW_LEVELS, ('g', 'place'))},
{_merkle_fold('subroots', f'rows_fold{ROW_LEVELS - 1}', GROUP_LEVELS, ('one', 'g'))}
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.digest AS verified
FROM subroots_fold{GROUP_LEVELS - 1} f JOIN subroots0 s ON s.place = f.g, subroots{GROUP_LEVELS} r"""


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t, role AS r FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant'),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn, role, t) AS turns,
         string_agg(CASE WHEN role = 'assistant' THEN t ELSE '' END, '' ORDER BY turn, role, t) AS loss,
         sum(length('<turn ' || role || '>' || chr(10) || '</turn>' || chr(10)) + length(t) + len(regexp_extract_all(t, '<\\*/?turn'))) AS chars,
         string_agg(coalesce(r, '?'), ' ' ORDER BY turn, role, t) AS roles,
         bool_and(coalesce(r IN ('system', 'user', 'assistant'), false)) AS usual, ((coalesce(any_value(conv_id), 0) % 5) + 5) % 5 AS pick
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
       CASE WHEN usual AND pick = 1 THEN 'shared' WHEN roles IN ('user assistant', 'system user assistant') AND pick = 2 THEN 'prompt'
            WHEN roles IN ('user assistant', 'system user assistant') AND pick = 3 THEN 'instruction'
            WHEN roles = 'user assistant' AND pick = 4 THEN 'pair' ELSE 'messages' END AS layout
FROM g"""

ORACLES = {
    "op12_schema_chat_format": CHAT_SQL,
    "op11_rank_index_fim": FIM_SQL,
    "op13_butterfly_manifest": manifest_sql(),
    "op2_merkle_fixity": FIXITY_SQL,
    "op9_weak_supervision_rules": weak_rules_sql(),
}
