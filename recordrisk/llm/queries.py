"""Registered queries of the operators, with their SQL where SQL can say it."""

from pyspark.sql import functions as F

from recordrisk.llm.block_dedup import remove_repeated_words
from recordrisk.llm.decontaminate import find_passages
from recordrisk.llm.conversations import damaged, repair, turns_of
from recordrisk.llm.divergence import audit
from recordrisk.llm.exact_dedup import exact_groups
from recordrisk.llm.line_dedup import remove_repeated_lines
from recordrisk.llm.near_dedup import near_classes
from recordrisk.llm.ngram_lm import score_texts
from recordrisk.llm.packing import pack
from recordrisk.llm.quality import fit_quality, in_fold, score_quality
from recordrisk.llm.secrets import ALPHABET, METHOD, PATTERNS, SCALE, WORD, fit_secrets, secret_report
from recordrisk.llm.shared import table
from recordrisk.llm.suffix_dedup import remove_repeated_bytes
from recordrisk.llm.token_counts import count_tokens
from recordrisk.workspace import shared_folder

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name="byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op2_exact_dedup(spark, sf_dir):
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(), shared_folder(spark, "token-cache"), limit=512)


@query("op9_quality")
def op9_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", in_fold().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary(), capacity=2048)


@query("op1_near_dedup")
def op1_near_dedup(spark, sf_dir):
    return near_classes(table(spark, sf_dir, "documents"))


@query("op3_decontaminate")
def op3_decontaminate(spark, sf_dir):
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark, sf_dir):
    return remove_repeated_bytes(table(spark, sf_dir, "documents"), least=200)


@query("op7_block_dedup")
def op7_block_dedup(spark, sf_dir):
    return remove_repeated_words(table(spark, sf_dir, "documents"), window=50)


@query("op5_lm_score")
def op5_lm_score(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


@query("op8_line_dedup")
def op8_line_dedup(spark, sf_dir):
    return remove_repeated_lines(table(spark, sf_dir, "documents"), every=True)


DIVERGENCE_SQL = r"""
    WITH d AS (SELECT coalesce(text, '') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id FROM documents),
    w AS (SELECT id, lang, source, unnest(regexp_extract_all(
        translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
    langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    cells AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
    filled AS (SELECT lang, source, term, coalesce(c, 0) AS c, k.n AS all_c FROM g JOIN kept k USING (lang) LEFT JOIN cells USING (lang, source, term)),
    p AS (SELECT lang, source, term, c, 1 + CAST(1000000000 * (c + 2)::HUGEINT // (sum(c) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p,
        1 + CAST(1000000000 * (all_c + 2)::HUGEINT // (total + 2 * v) AS BIGINT) AS q FROM filled JOIN langs USING (lang)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS s
        FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    found AS (SELECT * FROM pairs UNION ALL
        SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
    QUALIFY part = 'pair' OR rank <= 10"""


@query("op11_divergence", DIVERGENCE_SQL)
def op11_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


def _repair_sql() -> str:
    """Backwards over the rows of all conversations at once, with the least (cost, audit) from each of the four states."""
    some = lambda cost, letter, line, then: f"{{'c': {then}.c + {cost}, 'a': '{letter}' || {then}.a, 'r': {line} || {then}.r}}"
    given = ["user", "user", "assistant", "user"]
    then = ["s2", "s2", "s3", "s2"]
    kept = [{"s": "s1", "u": "s2"}, {"u": "s2"}, {"a": "s3"}, {"u": "s2"}]
    states = []
    for i in range(4):
        keep = " ".join(f"WHEN '{k}' THEN {some('cut', 'K', 'chr(10) || role || chr(58) || text', v)}" for k, v in kept[i].items())
        rename = some("cut + 1", "R", f"chr(10) || '{given[i]}:' || text", then[i])
        drop = some("2", "D", "''", f"s{i}")
        states.append(f"CASE WHEN gone THEN {drop} ELSE least({drop}, CASE substr(role, 1, 1) {keep} END, {rename}) END AS b{i}")
    more = lambda role, then: some("5", "I", f"chr(10) || '{role}:'", then)
    lines = ["''", "chr(10) || 'user:' || chr(10) || 'assistant:'", "chr(10) || 'assistant:'", "''"]
    end = ", ".join(f"{{'c': {5 * n}, 'a': '{'I' * n}', 'r': {x}}} AS s{i}" for i, (n, x) in enumerate(zip((0, 2, 1, 0), lines)))
    return rf"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)),
        lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS t),
    named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, row_number() OVER () AS uid,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
    hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1])), 4294967295) % 20 AS k FROM named, crc),
    dealt AS (SELECT conv_id, turn, uid, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
        CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE k <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, uid, copy) AS i,
        regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) AS last_char, left(role, 1) AS initial FROM dealt),
    judged AS (SELECT *, CASE WHEN last_char = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN last_char NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM placed),
    lines AS (SELECT conv_id, i, role, text, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS cut FROM judged),
    walk AS (
      SELECT conv_id, max(i) + 1 AS i, {end} FROM lines GROUP BY conv_id
      UNION ALL
      SELECT conv_id, i, least(b0, {more('user', 'f2')}) AS s0, least(b1, {more('user', 'f2')}) AS s1, f2 AS s2, least(b3, {more('user', 'b2')}) AS s3
      FROM (SELECT *, least(b2, {more('assistant', 'b3')}) AS f2 FROM (
        SELECT lines.conv_id, lines.i, {', '.join(states)}
        FROM walk JOIN lines ON walk.conv_id IS NOT DISTINCT FROM lines.conv_id AND lines.i = walk.i - 1))),
    repaired AS (SELECT conv_id, CAST(s0.c AS BIGINT) AS cost, s0.a AS audit, sha256(substr(s0.r, 2)) AS repaired_sha256 FROM walk WHERE i = 1),
    counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counted ON c.conv_id IS NOT DISTINCT FROM counted.conv_id
    LEFT JOIN repaired ON c.conv_id IS NOT DISTINCT FROM repaired.conv_id"""


@query("op12_conversations", _repair_sql())
def op12_conversations(spark, sf_dir):
    turns = turns_of(table(spark, sf_dir, "conversations"))
    return repair(damaged(turns), turns)


def _secrets_sql(least=16, word_least=8, bound=0.75) -> str:
    """Matches with their places from the texts between them; both models from counts of characters that follow each other."""
    kinds = [*PATTERNS, (METHOD, f"{WORD}{{{word_least},}}", 0, word_least)]  # identifiers, of which the longer ones are candidates
    found = " UNION ALL ".join(f"""SELECT uid, {i} AS rank, '{kind}' AS kind, {least_of} AS least, string_split_regex(t, pat) AS gaps,
      regexp_extract_all(t, pat, 0) AS whole, regexp_extract_all(t, pat, {group}) AS vals FROM d, (SELECT '{pattern.replace("'", "''")}' AS pat)"""
                               for i, (kind, pattern, group, least_of) in enumerate(kinds))
    size = len(ALPHABET)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
    found AS ({found}),
    each AS (SELECT uid, rank, kind, least, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, vals FROM found),
    placed AS (SELECT uid, rank, kind, least, vals[i] AS value, length(whole[i]) AS size,
        CAST(sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY uid, rank ORDER BY i) AS BIGINT) AS stop FROM each),
    spans AS (SELECT uid, rank, kind, value, stop - size AS start, stop FROM placed WHERE length(value) >= least),
    base AS (SELECT * FROM spans WHERE rank < {len(PATTERNS)}),
    words AS (SELECT * FROM spans s WHERE rank = {len(PATTERNS)} AND NOT EXISTS (SELECT 1 FROM base b WHERE b.uid = s.uid AND b.start < s.stop AND s.start < b.stop)),
    samples AS (SELECT DISTINCT 1 AS random, value FROM base
        UNION ALL SELECT 0, value FROM words WHERE regexp_matches(value, '[A-Za-z]') GROUP BY value HAVING count(*) > 1),
    letters AS (SELECT random, value, unnest(range(1, length(value) + 1)) AS i FROM samples),
    pairs AS (SELECT CASE WHEN i = 1 THEN '' ELSE substr(value, i - 1, 1) END AS former, substr(value, i, 1) AS c,
        count(*) FILTER (random = 1) AS yes, count(*) FILTER (random = 0) AS no FROM letters GROUP BY ALL),
    formers AS (SELECT former, sum(yes) AS yes_all, sum(no) AS no_all FROM pairs GROUP BY former),
    candidates AS (SELECT DISTINCT value FROM words WHERE length(value) >= {least} AND regexp_matches(value, '[A-Za-z]')),
    steps AS (SELECT value, i, CASE WHEN i = 1 THEN '' ELSE substr(value, i - 1, 1) END AS former, substr(value, i, 1) AS c
        FROM (SELECT value, unnest(range(1, length(value) + 1)) AS i FROM candidates)),
    known AS (SELECT value, coalesce(yes, 0) AS yes, coalesce(no, 0) AS no, coalesce(yes_all, 0) AS yes_all, coalesce(no_all, 0) AS no_all
        FROM steps LEFT JOIN pairs USING (former, c) LEFT JOIN formers USING (former)),
    ratios AS (SELECT value, sum(CAST(round({SCALE} * (ln(CASE WHEN yes_all > 0 THEN yes * {size} + yes_all ELSE 2 END)
        - ln(2 * {size} * greatest(yes_all, 1)) - ln(no + 1) + ln(no_all + {size}))) AS BIGINT)) AS ratio FROM known GROUP BY value),
    kept AS (SELECT uid, rank, kind, start, stop FROM base UNION ALL
        SELECT uid, rank, kind, start, stop FROM words JOIN ratios USING (value) WHERE ratio >= length(value) * {int(bound * SCALE)}),
    listed AS (SELECT uid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) FILTER (rank < {len(PATTERNS)}) AS base,
        string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, rank) AS spans FROM kept GROUP BY uid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
      sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (uid)"""


@query("op13_secrets", _secrets_sql())
def op13_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_report(docs, fit_secrets(docs))
