"""DuckDB SQL for the spelling query: crc32 byte by byte, near words by their text without one code point."""

SQL = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS entry FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, b:
      CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM range(256) bytes(b))
), runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), hashed AS (
  SELECT run, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(
      range(octet_length(encode(key))), lambda k: ('0x' || substr(hex(encode(key)), 2 * k + 1, 2))::BIGINT)),
    lambda c, byte: xor(c // 256, entry[xor(c % 256, byte) + 1]))) AS h
  FROM (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM runs WHERE length(run) >= 7), crc_table
), words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
      ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7
  GROUP BY word HAVING count(*) >= 2
), less AS (
  SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word
), formed AS (
  SELECT w.word, w.n, count(near) AS n_near,
    CASE WHEN max(near_n) >= 10 * w.n THEN (arg_min(near, (-near_n, near))) END AS form,
    CASE WHEN max(near_n) >= 10 * w.n THEN max(near_n) END AS form_n
  FROM words w LEFT JOIN near x ON w.word = x.word GROUP BY w.word, w.n
), walk AS (
  SELECT word, word AS root, form AS onward FROM formed
  UNION ALL
  SELECT walk.word, walk.onward, formed.form FROM walk JOIN formed ON walk.onward = formed.word
)
SELECT formed.word, form, root, n, n_near, form_n
FROM formed JOIN walk ON formed.word = walk.word AND walk.onward IS NULL
"""
