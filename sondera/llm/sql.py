"""SQL of the corpus queries, written for DuckDB and independent of the operators."""

DECONTAMINATION = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), i AS (
    SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), ds AS (
    SELECT doc_id, p, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM d WHERE len(w) >= 5)
), si AS (
    SELECT item_id, p, len(w) AS n, list_aggregate(w[p:p + 4], 'string_agg', ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS p FROM i WHERE len(w) >= 5)
), hits AS (
    SELECT DISTINCT doc_id, item_id, ds.p - si.p AS start, n FROM ds JOIN si USING (s)
), windows AS (
    SELECT h.doc_id, h.item_id, h.start, ds.s, count(*) AS c
    FROM hits h JOIN ds ON ds.doc_id = h.doc_id AND ds.p > h.start AND ds.p <= h.start + h.n - 4
    GROUP BY ALL
), items AS (
    SELECT item_id, s, count(*) AS c FROM si GROUP BY ALL
), pairs AS (
    SELECT h.doc_id, h.item_id, h.start, coalesce(w.s, i.s) AS s,
        coalesce(w.c, 0) AS wc, coalesce(i.c, 0) AS ic
    FROM (SELECT * FROM hits JOIN items USING (item_id)) h
    JOIN items i ON i.item_id = h.item_id AND i.s = h.s
    LEFT JOIN windows w ON w.doc_id = h.doc_id AND w.item_id = h.item_id AND w.start = h.start AND w.s = i.s
    UNION ALL
    SELECT w.doc_id, w.item_id, w.start, w.s, w.c, 0
    FROM windows w ANTI JOIN items i ON i.item_id = w.item_id AND i.s = w.s
), scored AS (
    SELECT doc_id, item_id, start,
        CAST(sum(length(replace(s, ' ', '')) * least(wc, ic)) AS DOUBLE)
            / sum(length(replace(s, ' ', '')) * greatest(wc, ic)) AS similarity
    FROM pairs GROUP BY ALL
)
SELECT doc_id, item_id, arg_max(start, (similarity, -start)) AS start_word, max(similarity) AS similarity
FROM (SELECT doc_id, item_id, greatest(start, 0) AS start, similarity FROM scored WHERE similarity >= 0.8)
GROUP BY doc_id, item_id
"""


_WORDS = r"""
d AS (
    SELECT doc_id, source, coalesce(text, '') AS text,
        coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w
    FROM documents
)"""

CURRICULUM_MIX = rf"""
WITH {_WORDS}, n AS (
    SELECT doc_id, source, len(w) AS size, md5(CAST(doc_id AS VARCHAR)) AS o FROM d
), totals AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
        row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn
    FROM n GROUP BY source
), leveled AS (
    SELECT *, turn % 3 + 1 AS weight, 3 * source_size / (turn % 3 + 1) AS "full" FROM totals
), level AS (
    SELECT *, (sum(source_size) OVER () - (sum(3 * source_size) OVER o - 3 * source_size))
            / (sum(weight) OVER () - sum(weight) OVER o + weight) AS own
    FROM leveled WINDOW o AS (ORDER BY "full", turn ROWS UNBOUNDED PRECEDING)
), targets AS (
    SELECT *, least(CAST(3 * source_size AS DOUBLE),
        coalesce(max(own) FILTER (own <= "full") OVER (), 0) * weight) AS target
    FROM level
), placed AS (
    SELECT n.*, source_size, turn, target, size * n_docs > source_size AS large,
        CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes
    FROM n JOIN targets t ON n.source IS NOT DISTINCT FROM t.source
), summed AS (
    SELECT *, target - passes * source_size AS more,
        sum(size) OVER (PARTITION BY source, large ORDER BY o, doc_id ROWS UNBOUNDED PRECEDING) - size
            + size / 2 AS middle,
        sum(size) OVER (PARTITION BY source, large) AS in_class
    FROM placed
), first_part AS (
    SELECT *, large AND middle <= more * in_class / source_size AS picked FROM summed
), decided AS (
    SELECT *, more - coalesce(sum(size) FILTER (picked) OVER (PARTITION BY source), 0) AS rest
    FROM first_part
), counted AS (
    SELECT *, CASE WHEN size = 0 THEN 0
        ELSE passes + CAST(CASE WHEN large THEN picked ELSE middle <= rest END AS INTEGER) END AS copies
    FROM decided
), taken AS (
    SELECT doc_id, source, turn, pass, size,
        sum(size) OVER (PARTITION BY source ORDER BY pass, o, doc_id ROWS UNBOUNDED PRECEDING) AS last_word,
        sum(size) OVER (PARTITION BY source) AS words
    FROM (SELECT *, unnest(range(copies)) AS pass FROM counted)
), shared AS (
    SELECT doc_id, source, turn % 3 AS kind, (last_word - size / 2) / words AS q FROM taken WHERE pass = 0
), placed_first AS (
    SELECT doc_id, source, CASE kind
        WHEN 1 THEN least(2 * q / (1 + sqrt(1.0)), 1.0)
        WHEN 0 THEN CASE
            WHEN q >= 0.625 THEN least(0.5 + 2 * (q - 0.625) / (1 + sqrt(1 - 2 * (q - 0.625))), 1.0)
            ELSE least(2 * q / (1.5 + sqrt(2.25 - 2 * q)), 0.5) END
        ELSE CASE
            WHEN q >= 0.375 THEN least(0.5 + 2 * (q - 0.375) / (1 + sqrt(1 + 2 * (q - 0.375))), 1.0)
            ELSE least(2 * q / (0.5 + sqrt(0.25 + 2 * q)), 0.5) END
        END AS first_position
    FROM shared
)
SELECT c.doc_id, c.source, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies AS INTEGER) AS copies,
    CAST(size * copies AS BIGINT) AS taken, CAST(first_position AS DOUBLE) AS first_position
FROM counted c LEFT JOIN placed_first p
    ON c.doc_id IS NOT DISTINCT FROM p.doc_id AND c.source IS NOT DISTINCT FROM p.source
"""

LINE_FREQUENCY = rf"""
WITH {_WORDS}, windows AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 7], ' ')) AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8)
), repeated AS (
    SELECT doc_id, count(DISTINCT i) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(p, p + 8)) AS i FROM windows WHERE c > 1) GROUP BY doc_id
), split AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS l,
        unnest(range(len(string_split(text, chr(10))))) AS i
    FROM d
), lines AS (
    SELECT doc_id, source, l, i, len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words,
        trim(regexp_replace(regexp_replace(lower(l), '[0-9]+', '0', 'g'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS line
    FROM split WHERE regexp_matches(l, '[^\x20\x09-\x0D]')
), whole AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS document FROM lines GROUP BY doc_id
), frequent AS (
    SELECT source, line FROM lines JOIN whole USING (doc_id) GROUP BY source, line HAVING count(DISTINCT document) > 100
), counted AS (
    SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY doc_id
), removed AS (
    SELECT doc_id, sum(words) AS words
    FROM lines SEMI JOIN frequent
        ON lines.line = frequent.line AND lines.source IS NOT DISTINCT FROM frequent.source
    GROUP BY doc_id
), measured AS (
    SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        CAST(coalesce(removed.words, 0) AS BIGINT) AS removed_words
    FROM d LEFT JOIN repeated USING (doc_id) LEFT JOIN counted USING (doc_id) LEFT JOIN removed USING (doc_id)
), failed AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured
)
SELECT *, NOT base_failed AND n_words - removed_words >= 0.3 * n_words AS kept FROM failed
"""

SUFFIX_DEDUP = rf"""
WITH {_WORDS}, windows AS (
    SELECT doc_id, p, count(*) OVER (PARTITION BY array_to_string(w[p:p + 34], ' ')) AS c
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM windows WHERE c > 1
), words AS (
    SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n
    FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

CHOSEN_PATH = rf"""
WITH RECURSIVE {_WORDS}, s AS (
    SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), near AS (
    SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
    WHERE 10 * pairs.n >= 8 * (p.n + q.n - pairs.n)
), links AS (
    SELECT a, b FROM near UNION ALL SELECT b, a FROM near
), reach AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), classes AS (
    SELECT a, min(b) AS least FROM reach GROUP BY a
), degrees AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, coalesce(n, 0) AS n_links
FROM documents LEFT JOIN classes c ON c.a = doc_id LEFT JOIN degrees g ON g.a = doc_id
"""

_VECTORS = """
v AS (
    SELECT vec_id, label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS f
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
)"""

VORONOI_JOIN = f"""
WITH {_VECTORS}, scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM scored
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM ranked WHERE n <= 5
"""

BOND_NEGATIVES = f"""
WITH {_VECTORS}, marked AS (
    SELECT vec_id, f, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM v WHERE label IS NOT NULL
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same,
        CAST(list_inner_product(a.f, c.f) AS BIGINT) AS score
    FROM marked a JOIN marked c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
), positives AS (
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM scored WHERE same
    ) WHERE n <= 5
), negatives AS (
    SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
        n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS n
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
        AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE n <= 3
"""


def _crc_rest(i: int, polynomial: int = 0xEDB88320) -> int:
    for _ in range(4):
        i = i >> 1 ^ (polynomial if i & 1 else 0)
    return i


def _crc_half(value: str) -> str:
    """SQL for four bits of crc32; DuckDB has no such function."""
    rests = ", ".join(f"{_crc_rest(i)}::BIGINT" for i in range(16))
    return f"xor([{rests}][1 + (({value}) & 15)], ({value}) >> 4)"


SPELLING_VARIANTS = rf"""
WITH RECURSIVE runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
        translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS r FROM documents)
), counted AS (
    SELECT run, count(*) AS c, hex(encode(doc || ':' || run)) AS b FROM runs GROUP BY doc, run
), hashed AS (
    SELECT run, c, xor(4294967295::BIGINT, list_reduce(
        [4294967295::BIGINT] || [CAST('0x' || b[2 * i - 1 : 2 * i] AS BIGINT) FOR i IN range(1, len(b) // 2 + 1)],
        lambda v, x: {_crc_half(_crc_half("xor(v, x)"))})) AS h
    FROM counted
), slipped AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c
    FROM hashed
), v AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), shorter AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
    SELECT a.word, b.word AS near FROM shorter a JOIN shorter b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT shorter.word, v.word FROM shorter JOIN v ON rest = v.word
    UNION SELECT v.word, shorter.word FROM shorter JOIN v ON rest = v.word
), ranked AS (
    SELECT near.word, near, m.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY m.n DESC, near) AS r
    FROM near JOIN v m ON m.word = near
), formed AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
        CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
    FROM v LEFT JOIN ranked r ON r.word = v.word AND r.r = 1
), path AS (
    SELECT word, form AS root FROM formed WHERE form IS NOT NULL
    UNION ALL
    SELECT path.word, f.form FROM path JOIN formed f ON f.word = path.root WHERE f.form IS NOT NULL
), ends AS (
    SELECT path.word, path.root FROM path JOIN formed f ON f.word = path.root WHERE f.form IS NULL
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN ends USING (word)
"""

SQL = {
    "op2_curriculum_mix": CURRICULUM_MIX,
    "op3_decontamination": DECONTAMINATION,
    "op4_line_frequency": LINE_FREQUENCY,
    "op5_suffix_dedup": SUFFIX_DEDUP,
    "op7_chosen_path": CHOSEN_PATH,
    "op11_spelling_variants": SPELLING_VARIANTS,
    "op12_voronoi_join": VORONOI_JOIN,
    "op13_bond_negatives": BOND_NEGATIVES,
}
