"""SQL text shared by the oracles: the derived inputs written as common table expressions."""

NL = "chr(10)"


def key(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, '[?]') THEN '[?]' ELSE "
        rf"coalesce(nullif(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_]', '', 'g'), ''), {c}) END"
    )


TOK = """tok AS (
 SELECT page_id, pos, CASE WHEN t = chr(1) THEN chr(10) ELSE t END AS tok FROM (
  SELECT doc_id AS page_id, unnest(range(len(a))) AS pos, unnest(a) AS t FROM (
   SELECT doc_id, string_split_regex(replace(trim(text, ' ' || chr(10)), chr(10), ' ' || chr(1) || ' '), ' +') AS a
   FROM documents)))"""

CELLS = f"""{TOK}, cells AS (
 SELECT page_id, pos, tok, k, c, {key('c')} AS key FROM (
  SELECT page_id, pos, tok, k,
   CASE WHEN tok = chr(10) THEN tok WHEN h = 36 OR (h = 33 AND k % 2 = 1) THEN '[?]'
    WHEN h % 6 = 0 AND (h >> (k - 1)) & 1 = 1 THEN translate(tok, 'e1', CASE WHEN k % 2 = 1 THEN 'a7' ELSE 'o4' END)
    ELSE tok END AS c
  FROM (SELECT *, (pos * 31 + page_id * 17) % 47 AS h FROM tok), (SELECT unnest([1,2,3,4,5]) AS k)))"""

COUNTS = f"""{CELLS}, cnt AS (
 SELECT page_id, pos, key, count(*) AS v, min(k) AS fk,
  coalesce(nullif(trim(arg_min(c, k + CASE WHEN contains(c, '[') THEN 100 ELSE 0 END), '[]'), ''), arg_min(c, k)) AS surface
 FROM cells WHERE tok <> chr(10) AND key <> '[?]' GROUP BY ALL),
best AS (
 SELECT page_id, pos, arg_max(key, v * 100 - fk) AS bkey, arg_max(surface, v * 100 - fk) AS surface, max(v) AS top,
  string_agg(surface || ':' || v, ',' ORDER BY fk) AS votes, list(v ORDER BY v DESC) AS vs
 FROM cnt GROUP BY ALL),
other AS (
 SELECT page_id, pos, bool_or(regexp_matches(c, '[0-9]')) FILTER (WHERE c <> '[?]') AS number,
  coalesce(string_agg(DISTINCT c, ',' ORDER BY c) FILTER (WHERE cells.key <> bkey AND cells.key <> '[?]'), '') AS alternatives,
  list_sort(coalesce(list(DISTINCT c) FILTER (WHERE cells.key <> bkey AND cells.key <> '[?]'), [])) AS alts,
  list(c ORDER BY k) AS models, string_agg(c, ',' ORDER BY k) AS by_model
 FROM cells LEFT JOIN best USING (page_id, pos) WHERE tok <> chr(10) GROUP BY ALL)"""

# words of the vote over the aligned readings, rule two_thirds with strict digits
VOTED = f"""{COUNTS}, voted AS (
 SELECT t.page_id, t.pos AS idx, t.tok AS truth,
  CASE WHEN t.tok = chr(10) THEN t.tok ELSE coalesce(b.surface, '[?]') END AS text,
  CASE WHEN t.tok <> chr(10) THEN coalesce(b.top, 0) END AS top,
  CASE WHEN t.tok <> chr(10) THEN coalesce(b.top, 0) / 5.0 END AS confidence,
  t.tok <> chr(10) AND (coalesce(b.top, 0) * 3 < 10 OR (coalesce(o.number, false) AND b.top < 5)) AS flagged,
  o.alternatives, o.alts, o.models, b.vs, coalesce(b.votes, '') AS votes, o.by_model, coalesce(o.number, false) AS number, b.bkey
 FROM tok t LEFT JOIN best b USING (page_id, pos) LEFT JOIN other o USING (page_id, pos))"""


def ascii_letters(c: str) -> str:
    """One ASCII letter per accented letter of the (lower-case) keys, so byte and character distances agree."""
    return f"translate({c}, 'éóèñçüêäößíàâîôûùáúëïœæ', 'ABCDEFGHIJKLMNOPQRSTUVW')"


# words of the benchmark passages; keys of three characters or more, the last spelling of a key wins
LEX = f"""lexw AS (SELECT item_id * 1000000 + pos AS ord, w AS word FROM (
  SELECT item_id, unnest(range(len(a))) AS pos, unnest(a) AS w FROM (
   SELECT item_id, string_split_regex(replace(trim(text, ' ' || chr(10)), chr(10), ' ' || chr(1) || ' '), ' +') AS a FROM benchmark)) WHERE w <> chr(1)),
lex AS (SELECT key, arg_max(word, ord) AS word FROM (SELECT word, ord, {key('word')} AS key FROM lexw) WHERE length(key) >= 3 GROUP BY key),
drugkeys AS (SELECT DISTINCT {key('word')} AS key FROM lexw WHERE length(word) > 3)"""

STRICT_TOKENS = "^(mg|mcg|ml|g|gm|iu|units?|od|bd|bid|tds|tid|qid|qds|hs|sos|stat|prn|ac|pc|tab|cap|syp|inj)[.]?$"


def strict(x: str, page: str) -> str:
    t = f"trim({x}, '.,;:()[]')"
    return (
        f"(contains({x}, '?') OR {t} = '' OR regexp_matches({t}, '[0-9]') OR regexp_matches(lower({t}), '{STRICT_TOKENS}') "
        f"OR ({page} = 'legal' AND left({t}, 1) = upper(left({t}, 1)) AND left({t}, 1) <> lower(left({t}, 1))))"
    )


PAGE_TYPE = "CASE page_id % 3 WHEN 0 THEN 'legal' WHEN 1 THEN 'note' ELSE 'auto' END"

# voted words with the second flag level
LIKELY = f"""{VOTED}, {LEX}, typed AS (SELECT *, {PAGE_TYPE} AS page_type, [text] || coalesce(alts, []) AS spellings FROM voted),
spelled AS (SELECT page_id, idx, unnest(spellings) AS s, page_type FROM typed WHERE flagged),
hard AS (SELECT page_id, idx, bool_or({strict('s', 'page_type')} OR k.key IS NOT NULL) AS hard
  FROM spelled LEFT JOIN drugkeys k ON k.key = {key("trim(s, '.,;:()[]')")} GROUP BY ALL),
words AS (SELECT t.*, coalesce(t.flagged AND len(vs) > 0 AND vs[1] / 5.0 >= 0.5 AND (len(vs) < 2 OR vs[2] < vs[1]) AND NOT hard, false) AS likely
  FROM typed t LEFT JOIN hard h USING (page_id, idx))"""
