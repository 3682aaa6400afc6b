"""DuckDB SQL for the rows of the queries that SQL can express.

Language models, token ids, packing and fingerprints have none; tests hold those against brute
force, exact round trips or held-out accuracy.
"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# Each measure in per mille with what a text may stray by chance; a bucket has 16 to a power of two.
_MEASURES = """
each AS (SELECT doc_id, lang, source, base_failed, unnest([
           struct_pack(m := 'word_length', v := word_chars * 1000 // greatest(n_words, 1), size := greatest(n_words, 1), event := NULL),
           struct_pack(m := 'symbols', v := n_symbols * 1000 // greatest(n_words, 1), size := greatest(n_words, 1), event := 1),
           struct_pack(m := 'dup_lines', v := n_dup_lines * 1000 // greatest(n_lines, 1), size := greatest(n_lines, 1), event := 1),
           struct_pack(m := 'repeats', v := n_repeat_words * 1000 // greatest(n_words, 1), size := greatest(n_words, 1), event := 10)]) AS e FROM counts),
values AS (SELECT * EXCLUDE (e), e.m AS m, e.v AS v, e.size AS size, e.event AS event, greatest(length(bin(e.v)) - 5, 0) AS shift FROM each),
passed AS (SELECT *, (v >> shift) << shift AS low, 1 << shift AS width FROM values WHERE NOT base_failed),
"""


def _level(name: str, keys: str) -> str:
    by = f"{keys}m"
    return f"""
{name}_run AS (SELECT {by}, low, width, sum(count(*)) OVER (PARTITION BY {by} ORDER BY low) AS c,
                 sum(count(*)) OVER (PARTITION BY {by}) AS total FROM passed GROUP BY {by}, low, width),
{name}_at AS (SELECT {by}, max(total) AS total, min(low) FILTER (c * 100 >= total * 25) AS q1,
                min(struct_pack(low, width)) FILTER (c * 100 >= total * 75) AS q3,
                min(struct_pack(low, width)) FILTER (c * 100 >= total * 90) AS d9 FROM {name}_run GROUP BY {by}),
{name} AS (SELECT {by}, total, q1 - 3 * greatest(q3.low - q1, q3.width) AS lo, q3.low + q3.width - 1 AS usual,
             greatest(q3.low + q3.width - 1 + 3 * greatest(q3.low - q1, q3.width),
                      d9.low + d9.width - 1 + 3 * greatest(d9.low - q3.low, d9.width)) AS hi FROM {name}_at),"""


QUALITY_RULES = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
grams AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(words) - 3)) AS r(i)),
twice AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS total, count(*) - count(DISTINCT l) AS n FROM
            (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (SELECT w.doc_id, lang, source, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(lines.total, 0) AS n_lines, coalesce(lines.n, 0) AS n_dup_lines,
             coalesce(covered.n, 0) AS n_repeat_words,
             len(words) < 10 OR 100 * coalesce(covered.n, 0) > 20 * len(words) AS base_failed
           FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)),
{_MEASURES}{_level('own', 'lang, source, ')}{_level('tongue', 'lang, ')}{_level('corpus', '')}
fenced AS (SELECT v.*, CASE WHEN own.total >= 200 THEN own.lo WHEN tongue.total >= 200 THEN tongue.lo ELSE corpus.lo END AS lo,
             CASE WHEN own.total >= 200 THEN own.hi WHEN tongue.total >= 200 THEN tongue.hi ELSE corpus.hi END AS hi,
             CASE WHEN own.total >= 200 THEN own.usual WHEN tongue.total >= 200 THEN tongue.usual ELSE corpus.usual END AS usual
           FROM values v
           LEFT JOIN own ON own.m = v.m AND own.lang IS NOT DISTINCT FROM v.lang AND own.source IS NOT DISTINCT FROM v.source
           LEFT JOIN tongue ON tongue.m = v.m AND tongue.lang IS NOT DISTINCT FROM v.lang
           LEFT JOIN corpus ON corpus.m = v.m),
judged AS (SELECT doc_id, bool_and(coalesce(
             v <= hi + coalesce(3000.0 * event / size, 1.5 * usual / sqrt(size))
             AND (m <> 'word_length' OR v >= lo - 1.5 * usual / sqrt(size)), true)) AS inside FROM fenced GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND inside AS kept
FROM counts JOIN judged USING (doc_id)
"""


def _escape(c: str) -> str:
    return rf"regexp_replace({c}, '([<\[])(\\*)(s>|/s>|sep>|INST\]|/INST\])', '\1\\\2\3', 'g')"


CHAT_FORMAT = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
              UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (SELECT *, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS starts FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_escape('text')}) + CASE WHEN starts THEN length('<s>[INST]  [/INST]</s>') + length({_escape('role')})
           ELSE length('<sep>') END)::BIGINT AS formatted_chars,
       count(*) FILTER (starts) AS n_blocks
FROM marked GROUP BY conv_id
"""


def _score(shard: int) -> str:
    digest = f"md5(coalesce(doc_id::VARCHAR, 'null') || ':{shard}')"
    return f"struct_pack(s := 1.0 / -ln((('0x' || substr({digest}, 1, 13))::BIGINT + 0.5) / 4503599627370496.0), i := {shard})"


CRC_TABLE = """
tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k:
               CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) AS r(i)),"""

SHARDING = f"""
WITH {CRC_TABLE}
base AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sums AS (SELECT doc_id, length(h) // 2 + 1 AS size,
           xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS text_crc32,
           greatest({', '.join(_score(i) for i in range(8))}).i AS shard,
           greatest({', '.join(_score(i) for i in range(9))}).i AS grown_shard FROM base, tab)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard
FROM sums
"""

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(words) - 11)) AS r(i)),
hit AS (SELECT doc_id, i FROM windows QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM hit, range(13) AS r(k) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(words[i], ' ' ORDER BY i) AS t FROM
           (SELECT w.doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w) x
         WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(places) AS i FROM gone) g WHERE g.doc_id = x.doc_id AND g.i = x.i) GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

FILTER_AUDIT = f"""
WITH base AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {WORDS} AS words FROM documents),
failed AS (SELECT part, doc_id,
             CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
             + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
             + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
             + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
             + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask FROM base),
cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
            count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic FROM failed GROUP BY part, mask),
letters(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
           FROM letters a, letters b, letters c, letters d, letters e
           WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, i::INT AS step, bits[i] AS own, coalesce(list_sum(bits[:i - 1]), 0)::BIGINT AS before
          FROM orders, range(1, 6) AS r(i)),
audit AS (SELECT part, filter_order, step, own,
            coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
            coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
            coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
            coalesce(sum(good) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost,
            coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost
          FROM cells, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM audit
"""

_TURN = "struct_pack(r := coalesce(role, ''), t := coalesce(text, ''))"
_TURN_DIGEST = "sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))"

CONVERSATION_TRIE = f"""
WITH {CRC_TABLE}
own AS (SELECT conv_id AS c, list({_TURN} ORDER BY turn NULLS FIRST, {_TURN_DIGEST}) AS l
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT c, l, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(c::VARCHAR)), lambda i: ascii((c::VARCHAR)[i + 1])::BIGINT)),
               lambda v, b: xor(t[(xor(v, b) & 255) + 1], v >> 8)), 4294967295) % 4 AS h FROM own, tab),
whole AS (SELECT h.c, list_concat(coalesce(b.l, [])[:h.h], h.l[h.h + 1:]) AS l FROM h LEFT JOIN own b ON b.c = h.c - h.c % 20),
walk AS (SELECT c, d, l[:d] AS key, l[d].t AS last, d = len(l) AS ends FROM (SELECT *, unnest(range(0, len(l) + 1)) AS d FROM whole)),
paths AS (SELECT c, d, last, ends, min(c) OVER same AS o, count(*) OVER same AS n FROM walk WINDOW same AS (PARTITION BY d, key)),
nodes AS (SELECT p.c, p.d, q.o AS parent, p.n, (p.n - 1) * len(regexp_extract_all(coalesce(p.last, ''), '[^\\x20\\x09-\\x0D]+')) AS saved
          FROM paths p LEFT JOIN paths q ON q.c = p.c AND q.d = p.d - 1 WHERE p.o = p.c),
kids AS (SELECT parent AS c, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
sums AS (SELECT p.o AS c, p.d, count(*) FILTER (kids.n IS NULL) AS leaves, sum(x.saved) AS saved
         FROM nodes x JOIN paths p ON p.c = x.c AND p.d <= x.d LEFT JOIN kids ON kids.c = x.c AND kids.d = x.d GROUP BY p.o, p.d),
ended AS (SELECT o AS c, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM paths WHERE ends GROUP BY o, d)
SELECT x.c AS conv_id, x.d AS depth, parent AS parent_conv_id, x.n AS n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves,
       sums.saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes x JOIN sums ON sums.c = x.c AND sums.d = x.d LEFT JOIN kids ON kids.c = x.c AND kids.d = x.d
LEFT JOIN ended ON ended.c = x.c AND ended.d = x.d
"""

ORACLE = {
    "op5_exact_dedup": EXACT_DEDUP,
    "op6_quality_rules": QUALITY_RULES,
    "op7_chat_format": CHAT_FORMAT,
    "op9_sharding": SHARDING,
    "op10_substring_dedup": SUBSTRING_DEDUP,
    "op11_filter_audit": FILTER_AUDIT,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
