"""SQL twins (DuckDB) of the queries SQL can say, under the names of the queries."""

op6_mix_sources = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight
  FROM docs GROUP BY source
), ranked AS (
  SELECT *, (3 * source_size)::DOUBLE / weight AS ratio,
         sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER ahead, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER ahead, 0) AS weights
  FROM sources
  WINDOW ahead AS (ORDER BY (3 * source_size)::DOUBLE / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT arg_min(rest::DOUBLE / weights, ratio) AS level FROM ranked WHERE rest::DOUBLE / weights <= ratio
), goals AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, level * weight) AS target FROM ranked, levels
), copies AS (
  SELECT d.doc_id, d.source, d.size, g.source_size, g.target, p.pass,
         md5(coalesce(d.doc_id::VARCHAR, 'null') || ':' || p.pass::VARCHAR) AS draw
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source
  JOIN (SELECT unnest([1, 2, 3]) AS pass) p ON p.pass <= least(3, floor(g.target / g.source_size) + 1)
  WHERE d.size > 0 AND g.target > 0
), timed AS (
  SELECT *, ((pass - 1) * source_size + sum(size) OVER (
      PARTITION BY source, pass ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING))::DOUBLE / target AS vtime
  FROM copies
), merged AS (
  SELECT *, sum(size) OVER (ORDER BY vtime, source ASC NULLS LAST, draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM timed
), taken AS (
  SELECT doc_id, sum(size) AS taken FROM merged WHERE upto <= (SELECT sum(source_size) FROM sources) GROUP BY doc_id
)
SELECT d.doc_id, d.size::BIGINT AS size, g.source_size, g.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN taken t ON d.doc_id = t.doc_id
"""

op9_pivot_top_k = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

op1_benchmark_leaks = r"""
WITH docs AS (
  SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
  FROM benchmark WHERE text IS NOT NULL
), item_shingles AS (
  SELECT item_id, len(w) AS n_words, unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS h
  FROM items WHERE len(w) >= 5
), weights AS (
  SELECT item_id, n_words, h, count(*) AS times, sum(count(*)) OVER (PARTITION BY item_id) AS need
  FROM item_shingles GROUP BY item_id, n_words, h
), shingled AS (
  SELECT doc_id, len(w) - 4 AS total, unnest(range(0, len(w) - 4)) AS pos,
         unnest([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS h
  FROM docs WHERE len(w) >= 5
), hits AS (
  SELECT s.doc_id, s.total, s.pos, i.item_id, i.n_words, i.need FROM shingled s JOIN weights i USING (h)
), starts AS (
  SELECT doc_id, item_id, n_words, need, least(need, total) AS size, pos - back AS start
  FROM hits, unnest(range(0, need::BIGINT)) AS b(back)
  WHERE pos - back >= 0 AND pos - back <= total - least(need, total)
  GROUP BY doc_id, item_id, n_words, need, total, pos - back HAVING count(*) >= 0.8 * need
), inside AS (
  SELECT t.doc_id, t.item_id, t.n_words, t.need, t.size, t.start, s.h, count(*) AS mine
  FROM starts t JOIN shingled s ON s.doc_id = t.doc_id AND s.pos >= t.start AND s.pos < t.start + t.size
  GROUP BY ALL
), scored AS (
  SELECT doc_id, item_id, n_words, start, sum(least(mine, times))::DOUBLE / (any_value(i.need) + any_value(size) - sum(least(mine, times))) AS similarity
  FROM inside i JOIN (SELECT item_id, h, times FROM weights) USING (item_id, h)
  GROUP BY doc_id, item_id, n_words, start
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place FROM scored WHERE similarity >= 0.8
)
SELECT doc_id, item_id, start::BIGINT AS start, n_words::BIGINT AS n_words, similarity FROM ranked WHERE place = 1
"""

op4_line_templates = r"""
WITH cut AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS content, unnest(range(0, len(string_split(text, chr(10))))) AS line
  FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, line, list_transform(list_filter(regexp_split_to_array(content, '[\x20\x09-\x0D]+'), lambda t: t <> ''),
                                      lambda t: CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END) AS toks
  FROM cut
), keyed AS (
  SELECT doc_id, line, toks, len(toks) AS n, toks[1:3] AS lead FROM lines WHERE len(toks) > 0
), often AS (
  SELECT n, lead, toks, count(*) AS times FROM keyed GROUP BY ALL
), votes AS (
  SELECT n, lead, place, token, sum(times) AS votes
  FROM (SELECT n, lead, times, unnest(toks) AS token, unnest(range(1, n + 1)) AS place FROM often) GROUP BY ALL
), best AS (
  SELECT n, lead, place, arg_max(token, {'v': votes, 't': token}) AS token, max(votes) AS most, sum(votes) AS total FROM votes GROUP BY ALL
), matched AS (
  SELECT o.n, o.lead, o.toks, count(b.place) >= 0.7 * o.n AS belongs
  FROM (SELECT n, lead, toks, unnest(toks) AS token, unnest(range(1, n + 1)) AS place FROM often) o
  LEFT JOIN best b ON b.n = o.n AND b.lead = o.lead AND b.place = o.place AND b.token = o.token AND 2 * b.most >= b.total
  GROUP BY o.n, o.lead, o.toks
), named AS (
  SELECT k.doc_id, k.line, k.n, k.lead, CASE WHEN m.belongs THEN NULL ELSE k.toks END AS template
  FROM keyed k JOIN matched m ON k.n = m.n AND k.lead = m.lead AND k.toks = m.toks
), spread AS (
  SELECT n, lead, template FROM named GROUP BY ALL HAVING count(DISTINCT doc_id) >= 5
), dropped AS (
  SELECT a.doc_id, a.line FROM named a JOIN spread s ON a.n = s.n AND a.lead = s.lead AND a.template IS NOT DISTINCT FROM s.template
), kept AS (
  SELECT c.doc_id, count(*) AS n_lines, count(d.line) AS n_dropped,
         string_agg(CASE WHEN d.line IS NULL THEN c.content END, chr(10) ORDER BY c.line) AS body
  FROM cut c LEFT JOIN dropped d ON c.doc_id = d.doc_id AND c.line = d.line GROUP BY c.doc_id
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
       CASE WHEN text IS NULL THEN NULL ELSE md5(coalesce(body, '')) END AS kept_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""

op3_run_index_spans = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), strings AS (
  SELECT doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM docs, unnest(range(0, len(x) // 2 - 49)) AS r(i)
), firsts AS (
  SELECT s, min(doc_id) AS first FROM strings GROUP BY s
), marked AS (
  SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM strings JOIN firsts USING (s) WHERE doc_id > first
), islands AS (
  SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM marked
), spans AS (
  SELECT doc_id, island, min(i) AS a, max(i) + 50 AS b FROM islands GROUP BY doc_id, island
), gaps AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS from_ FROM spans
), cut AS (
  SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail,
         string_agg(substr(x, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS head
  FROM gaps g JOIN docs USING (doc_id) GROUP BY g.doc_id
)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(from_hex(CASE WHEN tail IS NULL THEN x ELSE head || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM docs LEFT JOIN cut USING (doc_id)
"""

op11_revisit_archives = r"""
WITH records AS (
  SELECT page_id, url, coalesce(html, '') AS body FROM pages
), coded AS (
  SELECT page_id, url, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS hexa FROM records
), digests AS (
  SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hexa, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest
  FROM coded
), ranked AS (
  SELECT *, row_number() OVER same AS place, first(page_id) OVER same AS original FROM digests
  WINDOW same AS (PARTITION BY payload_digest, payload_bytes ORDER BY page_id DESC NULLS LAST, url DESC NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN original END AS refers_to
FROM ranked
"""

op12_captured_middles = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents
), drawn AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS one,
         ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS two,
         text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 AS plain,
         ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 AS spm
  FROM cut
), parts AS (
  SELECT *, array_to_string(units[:least(one, two)], '') AS prefix,
         array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
         array_to_string(units[greatest(one, two) + 1:], '') AS suffix
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
       sha256(prefix || middle || suffix) AS restored_sha256
FROM parts
"""
