"""One query per operator, over its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from revisit.llm import (
    backoff_lm,
    byte_gru,
    decontamination,
    density,
    fertility,
    lattice,
    line_dedup,
    mask_search,
    prefix_trie,
    simhash,
    snapshots,
    substring_dedup,
    token_files,
)
from revisit.llm.registry import LLM_ORACLES, LLM_QUERIES, query, table
from revisit.plans.durable import new_path

__all__ = ["LLM_ORACLES", "LLM_QUERIES"]


# Windows compared as strings, in place of hashes.
_REPEATS = """
    WITH doc AS (
      SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    win AS (
      SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM doc WHERE len(w) >= 35)),
    again AS (
      SELECT doc_id, i FROM win JOIN (SELECT s FROM win GROUP BY s HAVING count(*) > 1) USING (s)),
    gone AS (SELECT DISTINCT doc_id, i + k AS place FROM again, range(35) t(k)),
    word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM doc),
    kept AS (
      SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS said
      FROM word ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(coalesce(said, '')) AS kept_sha256
    FROM doc LEFT JOIN kept USING (doc_id)
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""


@query("op1_substring_dedup", _REPEATS)
def op1_substring_dedup(spark, folder):
    made = substring_dedup.remove_repeats(table(spark, folder, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256)
    return made.select("doc_id", "n_words", "n_removed", digest.alias("kept_sha256"))


@query("op2_fertility")
def op2_fertility(spark, folder):
    return fertility.judged(table(spark, folder, "documents"))


# Conversations compared turn by turn, in place of hashes.
_SNAPSHOTS = """
    WITH conv AS (
      SELECT conv_id, list(struct_pack(role, text) ORDER BY turn) AS said,
             string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                        ORDER BY turn) AS chat
      FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id)
    SELECT min(conv_id) AS conv_id, len(said) AS n_turns, count(*) AS n_copies, min(chat) AS chat
    FROM conv c
    WHERE NOT EXISTS (
      SELECT 1 FROM conv l
      WHERE l.said[1] = c.said[1] AND len(l.said) > len(c.said) AND l.said[1:len(c.said)] = c.said)
    GROUP BY said"""


@query("op3_snapshots", _SNAPSHOTS)
def op3_snapshots(spark, folder):
    return snapshots.rendered(table(spark, folder, "conversations"))


# Lines and their variants as lists of words, in place of hashes and halves. A place in the corpus
# is one number: doc_id * 2**24 + line.
_LINES = """
    WITH split AS (
      SELECT doc_id, i - 1 AS pos, regexp_extract_all(lower(s), '[^\\x20\\x09-\\x0D]+') AS w
      FROM (SELECT doc_id, unnest(str_split(text, chr(10))) AS s,
                   generate_subscripts(str_split(text, chr(10)), 1) AS i FROM documents)),
    long_line AS (
      SELECT doc_id, pos, doc_id * 16777216 + pos AS place,
             CASE WHEN len(w) = 1 AND length(w[1]) >= 20
                  THEN list_concat(['', ''], regexp_extract_all(w[1], '.')) ELSE w END AS w
      FROM split WHERE len(w) > 0),
    distinct_line AS (SELECT w, min(place) AS place FROM long_line GROUP BY w),
    near_line AS (SELECT * FROM distinct_line WHERE len(w) >= 5),
    variant AS (
      SELECT w, place, p, list_concat(w[1:p - 1], w[p + 1:]) AS v
      FROM (SELECT w, place, unnest(range(1, len(w) + 1)) AS p FROM near_line)),
    partner AS (
      SELECT w, min(other) AS partner FROM (
        SELECT a.w, b.place AS other FROM variant a
        JOIN variant b ON a.p = b.p AND a.v = b.v AND b.place < a.place
        UNION ALL
        SELECT a.w, d.place FROM variant a JOIN near_line d ON a.v = d.w AND d.place < a.place
        UNION ALL
        SELECT d.w, b.place FROM near_line d JOIN variant b ON d.w = b.v AND b.place < d.place)
      GROUP BY w)
    SELECT l.doc_id, l.pos AS line, coalesce(partner, d.place) // 16777216 AS kept_doc_id,
           coalesce(partner, d.place) % 16777216 AS kept_line, partner IS NULL AS exact
    FROM long_line l JOIN distinct_line d USING (w) LEFT JOIN partner USING (w)
    WHERE partner IS NOT NULL OR l.place <> d.place"""


@query("op4_line_dedup", _LINES)
def op4_line_dedup(spark, folder):
    gone = line_dedup.repeated_lines(table(spark, folder, "documents"))
    whole = {c: F.col(c).cast("bigint") for c in ("line", "kept_line")}
    return gone.withColumns(whole)


# Every shingle of every item looked up in every document.
_CONTAINED = """
    WITH doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
    item AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
    item_shingle AS (
      SELECT DISTINCT item_id, least(len(w), 5) AS width, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
      FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM item WHERE len(w) > 0)),
    doc_shingle AS (
      SELECT DISTINCT doc_id, width, array_to_string(w[i:i + width - 1], ' ') AS s
      FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i
            FROM doc, (SELECT DISTINCT width FROM item_shingle))),
    size AS (SELECT item_id, count(*) AS n_item FROM item_shingle GROUP BY 1)
    SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
    FROM doc_shingle JOIN item_shingle USING (width, s) JOIN size USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING 5 * count(*) >= 4 * n_item"""


@query("op5_decontamination", _CONTAINED)
def op5_decontamination(spark, folder):
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontamination.contained_items(docs, items)


@query("op6_backoff_lm")
def op6_backoff_lm(spark, folder):
    return backoff_lm.score_texts(table(spark, folder, "documents"))


@query("op7_lattice")
def op7_lattice(spark, folder):
    return lattice.encode_sampled(table(spark, folder, "documents"), check=True)


@query("op8_token_files")
def op8_token_files(spark, folder):
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, folder, "documents"), path)
    made = token_files.with_crc32(token_files.read_tokens(spark, path))
    return made.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op9_density")
def op9_density(spark, folder):
    return density.extract(table(spark, folder, "pages"), carry=("url",))


@query("op10_simhash")
def op10_simhash(spark, folder):
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select(
        "doc_id", simhash.hex16("fp").alias("fingerprint"), F.col("component").alias("component_id")
    )


# Every document scored for every item.
_RANKED = """
    WITH doc AS (
      SELECT doc_id, regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
    item AS (
      SELECT item_id, unnest(list_distinct(regexp_extract_all(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
    size AS (
      SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(t)) AS BIGINT) AS terms FROM doc WHERE len(t) > 0),
    held AS (
      SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM doc)
      WHERE term IN (SELECT term FROM item) GROUP BY doc_id, n, term),
    weight AS (
      SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM held, size GROUP BY term, docs),
    scored AS (
      SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 *
               (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
      FROM item JOIN held USING (term) JOIN weight USING (term), size GROUP BY item_id, doc_id)
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
          FROM scored WHERE score > 0)
    WHERE rank <= 50"""


@query("op11_mask_search", _RANKED)
def op11_mask_search(spark, folder):
    return mask_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# Prefixes as texts, subtrees as pairs of nodes and ancestors. crc32 is worked out digit by digit.
_TRIE = """
    WITH crc AS (
      SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
               CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    conv AS (
      SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
                           ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS said
      FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    cut AS (
      SELECT conv_id, said, xor(4294967295, list_reduce(
               list_prepend(4294967295, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1),
                            lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
               lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 9 AS h
      FROM conv, crc),
    made AS (
      SELECT c.conv_id, list_concat(coalesce(b.said[1:c.h], []), c.said[c.h + 1:]) AS said
      FROM cut c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 5),
    path AS (
      SELECT conv_id, d, md5(CAST(to_json(said[1:d]) AS VARCHAR)) AS node, d = len(said) AS ended,
             CASE WHEN d > 0 THEN md5(CAST(to_json(said[1:d - 1]) AS VARCHAR)) END AS parent,
             CASE WHEN d > 0 THEN strlen(said[d].x) ELSE 0 END AS bytes
      FROM (SELECT *, unnest(range(len(said) + 1)) AS d FROM made)),
    node AS (
      SELECT node, min(conv_id) AS conv_id, min(d) AS depth, min(parent) AS parent, count(*) AS n_convs,
             (count(*) - 1) * min(bytes) AS saved,
             sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends
      FROM path GROUP BY node),
    kids AS (SELECT parent, count(*) AS n FROM node GROUP BY parent),
    total AS (
      SELECT p.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(u.saved) AS saved
      FROM node u JOIN path p ON p.conv_id = u.conv_id AND p.d <= u.depth
      LEFT JOIN kids k ON k.parent = u.node GROUP BY p.node)
    SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children,
           t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
    FROM node v JOIN total t USING (node) LEFT JOIN node p ON p.node = v.parent
    LEFT JOIN kids k ON k.parent = v.node"""


@query("op12_prefix_trie", _TRIE)
def op12_prefix_trie(spark, folder):
    return prefix_trie.shared_prefixes(table(spark, folder, "conversations"))


@query("op13_byte_gru")
def op13_byte_gru(spark, folder):
    return byte_gru.identify(table(spark, folder, "documents"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
