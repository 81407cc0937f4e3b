"""The same results in the SQL of the test oracle."""

MERKLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nxt
  FROM documents WINDOW w AS (ORDER BY doc_id, coalesce(text, '') ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (
  SELECT doc_id, t, nxt, left(t, (length(t) - length(t) // 4)::INT) || left(nxt, (length(t) // 4)::INT) AS e FROM d),
l AS (
  SELECT doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256,
    list_transform(string_split(t, chr(10)), lambda x: list_transform(string_split(x, '. '), lambda s: sha256(s))) AS lt,
    list_transform(string_split(e, chr(10)), lambda x: list_transform(string_split(x, '. '), lambda s: sha256(s))) AS le,
    list_transform(string_split(nxt, chr(10)), lambda x: list_transform(string_split(x, '. '), lambda s: sha256(s))) AS ln
  FROM e),
c AS (
  SELECT *, list_transform(flatten(lt), lambda x: left(x, 8)) AS ct, list_transform(flatten(le), lambda x: left(x, 8)) AS ce,
    list_transform(flatten(ln), lambda x: left(x, 8)) AS cn,
    string_split(regexp_replace(array_to_string(list_transform(lt, lambda x: sha256(array_to_string(x, '.'))), '.'),
      '([048c])\.', '\1|', 'g'), '|') AS st,
    string_split(regexp_replace(array_to_string(list_transform(le, lambda x: sha256(array_to_string(x, '.'))), '.'),
      '([048c])\.', '\1|', 'g'), '|') AS se
  FROM l)
SELECT doc_id, n_chars::BIGINT AS n_chars, edited_sha256,
  sha256(array_to_string(list_transform(st, lambda x: sha256(x)), '.')) || ':' ||
    array_to_string(list_transform(lt, lambda x: array_to_string(list_transform(x, lambda y: left(y, 8)), '.')), '/') AS fingerprint,
  sha256(array_to_string(list_transform(se, lambda x: sha256(x)), '.')) || ':' ||
    array_to_string(list_transform(le, lambda x: array_to_string(list_transform(x, lambda y: left(y, 8)), '.')), '/') AS edited_fingerprint,
  2.0::DOUBLE * len(list_intersect(ct, ce)) / (len(list_distinct(ct)) + len(list_distinct(ce))) AS near_edited,
  2.0::DOUBLE * len(list_intersect(ct, cn)) / (len(list_distinct(ct)) + len(list_distinct(cn))) AS near_next,
  list_filter(range(0, greatest(len(ct), len(ce))), lambda i: ct[i + 1] IS DISTINCT FROM ce[i + 1])[1]::BIGINT AS first_changed_leaf
FROM c
"""


def weight(name: str, weights: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def shared_out(depth: int, path: list[str], weights: dict[str, int], family_budget: str) -> str:
    """Common table expressions of one level of the tree: budgets b<depth>."""
    keys, family = ", ".join(path), ", ".join(path[:-1])
    part = f"PARTITION BY {family}" if family else ""
    parent = f"JOIN b{depth - 1} USING ({family})" if family else ""
    return f"""
k{depth} AS (
  SELECT {keys}, sum(tokens * EPOCHS) AS capacity, sum(tokens) AS tokens FROM leaves GROUP BY {keys}),
w{depth} AS (
  SELECT {", ".join(f"k{depth}.{p}" for p in path)}, k{depth}.capacity, k{depth}.tokens,
    {weight(path[-1], weights)} AS weight, {family_budget} AS family_budget FROM k{depth} {parent}),
f{depth} AS (
  SELECT *, capacity * sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <=
    (family_budget - coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS is_full
  FROM w{depth} WINDOW o AS ({part} ORDER BY capacity::DOUBLE / weight, {path[-1]})),
b{depth} AS (
  SELECT {keys}, tokens, CASE WHEN is_full THEN capacity ELSE
    ((family_budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({part})) * weight)
    // nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}), 0) END AS budget
  FROM f{depth})"""


def mixture(weights: dict[str, dict[str, int]], share: tuple[int, int], epochs: int, seed: int) -> str:
    names = list(weights)
    levels = []
    for depth, name in enumerate(names):
        total = f"(SELECT sum(tokens) * {share[0]} // {share[1]} FROM leaves)"
        family_budget = f"b{depth - 1}.budget" if depth else total
        levels.append(shared_out(depth, names[: depth + 1], weights[name], family_budget))
    keys = ", ".join(names)
    return rf"""
WITH counted AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, 'text ' || md5(coalesce(text, ''))) AS ident,
    coalesce('group' || (try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT) % 4)::VARCHAR, '(none)') AS domain,
    coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n_tokens
  FROM documents),
leaves AS (SELECT {keys}, sum(n_tokens) AS tokens FROM counted GROUP BY {keys}),
{",".join(levels).replace("EPOCHS", str(epochs))},
plan AS (
  SELECT *, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS full_epochs,
    budget - CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END * tokens AS rest
  FROM b{len(names) - 1}),
placed AS (
  SELECT c.*, p.full_epochs, p.rest, md5('{seed}:' || (full_epochs + 1)::VARCHAR || ':' || ident) AS place
  FROM counted c JOIN plan p USING ({keys})),
started AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY {keys} ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
    - sum(n_tokens) OVER (PARTITION BY {keys}, place) AS start
  FROM placed)
SELECT doc_id, {keys}, n_tokens::BIGINT AS n_tokens, (full_epochs + (start < rest)::INT)::BIGINT AS epochs,
  (full_epochs * n_tokens + CASE WHEN start < rest THEN least(n_tokens, rest - start) ELSE 0 END)::BIGINT AS tokens_taken
FROM started WHERE full_epochs + (start < rest)::INT > 0
"""


NEAREST = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0))
WHERE rank <= 20
"""


NEGATIVES = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (
  SELECT * FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, p.vec_id AS positive_id,
  row_number() OVER (PARTITION BY anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 100 * s.score BETWEEN 50 * p.score AND 95 * p.score
QUALIFY rank <= 3
"""


#: The table of the checksum is built from its polynomial, 3988292384.
VARIANTS = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
    lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS entries),
found AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS owner, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM found WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (
  SELECT *, hex(encode(owner || ':' || run)) AS digits FROM runs),
marked AS (
  SELECT run, n, xor(list_reduce(
    list_concat([4294967295::BIGINT], list_transform(range(length(digits) // 2), lambda i: ('0x' || digits[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295) AS mark
  FROM bytes, crc),
words AS (
  SELECT CASE WHEN mark % 31 = 0 THEN left(run, (mark % length(run))::INT) || substr(run, (mark % length(run))::INT + 2) ELSE run END AS word,
    sum(n)::BIGINT AS n
  FROM marked GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
cut AS (
  SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word FROM cut a JOIN words b ON a.rest = b.word),
counted AS (
  SELECT p.word, count(*) AS n_near, min({'fewer': -b.n, 'word': p.near}) AS best
  FROM pairs p JOIN words b ON p.near = b.word GROUP BY 1),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.fewer >= 10 * w.n THEN best.word END AS form,
    CASE WHEN -best.fewer >= 10 * w.n THEN -best.fewer END AS form_n
  FROM words w LEFT JOIN counted c USING (word)),
steps AS (
  SELECT word, coalesce(form, word) AS root, form IS NULL AS ended FROM forms
  UNION ALL SELECT s.word, coalesce(f.form, f.word), f.form IS NULL FROM steps s JOIN forms f ON s.root = f.word WHERE NOT s.ended)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN steps USING (word) WHERE ended
"""
