"""The same results in plain SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

from ..functions.tokens import DUTCH_STOP_WORDS, PUNCTUATION
from .tables import DISTRIBUTION_LISTS, TYPE_LISTS

LOWER, UPPER = "1870-01-01", "1970-12-31"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


STOP = ", ".join(_text(w) for w in DUTCH_STOP_WORDS)
WORD = _text(
    r"(?:[\p{L}\p{M}]+(?:['’‘.:·][\p{L}\p{M}]+)*|\p{N}+(?:['’‘.,;]\p{N}+)*|_+)+"
)
BLANKS = r"'[ \t\n\r\f]+'"


def words(text: str) -> str:
    return (
        f"list_filter(regexp_extract_all(lower({text}), {WORD}), "
        "lambda x: translate(x, '_', '') <> '')"
    )


def positions(text: str) -> str:
    return f"list_transform({words(text)}, lambda x: case when x in ({STOP}) then '' else x end)"


def analyzed(text: str) -> str:
    return f"list_filter({words(text)}, lambda x: x not in ({STOP}))"


def raw(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {BLANKS}), lambda x: x <> '')"


def stripped(text: str, at_least: int = 1) -> str:
    blank = _text(" " * len(PUNCTUATION))
    clean = f"translate(lower({text}), {_text(PUNCTUATION)}, {blank})"
    return f"list_filter(regexp_split_to_array({clean}, {BLANKS}), lambda x: length(x) >= {at_least})"


def count_of(tokens: str, source: str) -> str:
    return f"select term, count(*) as count from (select unnest({tokens}) as term from {source}) group by term"


ARTICLES = """articles as (
  select cast(doc_id as varchar) as identifier, doc_id, split_part(text, '.', 1) as article_dc_title,
    source as paper_dc_title, text as text_content,
    date '1850-01-01' + cast((doc_id * 7919) % 51499 as integer) as paper_dc_date,
    case when doc_id % 11 = 0 then null when doc_id % 4 = 0 then 'artikel'
      when doc_id % 4 = 1 then 'advertentie' when doc_id % 4 = 2 then 'illustratie met onderschrift'
      else 'familiebericht' end as article_dc_subject,
    case when doc_id % 13 = 0 then null when doc_id % 5 = 0 then 'Landelijk'
      when doc_id % 5 = 1 then 'Regionaal/lokaal' when doc_id % 5 = 2 then 'Nederlandse Antillen'
      when doc_id % 5 = 3 then 'Suriname' else 'Nederlands-Indië / Indonesië' end as paper_dcterms_spatial
  from documents)"""

ALL_TEXT = "concat_ws(' ', article_dc_title, paper_dc_title, text_content)"
CLOUD_TEXT = "concat_ws(' ', text_content, article_dc_title)"

WORDED = f"""{ARTICLES}, worded as (
  select *, ' ' || array_to_string(w, ' ') || ' ' as s, ' ' || array_to_string(tw, ' ') || ' ' as ts
  from (select *, {positions(ALL_TEXT)} as w, {positions("article_dc_title")} as tw from articles))"""

# A letter e with a combining accent; texts are rewritten with it.
_E = "e\u0301"
_ET = _E + "t"
DECOMPOSED = WORDED.replace("text as text_content", f"replace(text, 'é', '{_E}') as text_content")

IN_DATES = f"paper_dc_date between date '{LOWER}' and date '{UPPER}'"
NOT_PLACES = "coalesce(paper_dcterms_spatial not in ('Nederlandse Antillen', 'Suriname'), true)"
NOT_TYPES = "coalesce(article_dc_subject not in ('advertentie', 'familiebericht'), true)"

SELECTED = f"""{WORDED}, selected as (
  select * from worded where {IN_DATES} and {NOT_PLACES} and {NOT_TYPES}
    and list_contains(w, 'the') and (list_contains(w, 'and') or contains(s, ' that this ')))"""


def has(word: str) -> str:
    return f"list_contains(w, {_text(word)})"


def near(left: str, right: str, most: int) -> str:
    """Edit distance of at most 1 or 2, a swap of neighbours being one edit.

    A swap cuts both words in two, and what is left before and after it is as near as the edits that
    remain. DuckDB counts bytes, so accented letters become capitals.
    """
    one = lambda x: f"translate({x}, 'áàâäãéèêëíìîïñóòôöúùûüçßœ’', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
    x, y = one(left), one(right)
    swaps = lambda w: (
        f"list_transform(range(1, greatest(length({w}), 1)), lambda k: substr({w}, 1, k - 1) || substr({w}, k + 1, 1)"
        f" || substr({w}, k, 1) || substr({w}, k + 2))"
    )
    xb, yb, xa, ya = f"substr({x}, 1, j - 1)", f"substr({y}, 1, i - 1)", f"substr({x}, j + 2)", f"substr({y}, i + 2)"
    rest = (
        f"(levenshtein({xb}, {yb}) + levenshtein({xa}, {ya}) <= 1"
        f" or {xa} = {ya} and list_contains({swaps(yb)}, {xb}) or {xb} = {yb} and list_contains({swaps(ya)}, {xa}))"
    )
    swapped = {
        1: f"list_contains({swaps(y)}, {x})",
        2: f"len(list_filter(range(1, greatest(length({y}), 1)), lambda i: len(list_filter([i - 1, i, i + 1],"
        f" lambda j: j >= 1 and substr({x}, j, 2) = reverse(substr({y}, i, 2)) and length(substr({x}, j, 2)) = 2 and {rest})) > 0)) > 0",
    }[most]
    return f"(abs(length({x}) - length({y})) <= {most} and (levenshtein({x}, {y}) <= {most} or levenshtein({x}, {y}) <= {2 * most} and {swapped}))"


def some_word(test: str) -> str:
    return f"len(list_filter(w, lambda x: x <> '' and {test})) > 0"


MATCHES = {
    "match_term": has("heit"),
    "match_any": " or ".join(has(w) for w in ("heit", "keit", "oion", "ande", "anre", "ung", "or", "pas")),
    "match_all": " and ".join(has(w) for w in ("the", "and", "this")),
    "match_not": f"{has('the')} and not {has('with')}",
    "match_grouped": f"({has('heit')} and {has('keit')}) or (({has('la')} or {has('les')}) and not {has('un')})",
    "match_bool": f"({has('the')} and {has('and')} and not {has('by')}) or ({has('les')} and not {has('un')})",
    "match_phrase": f"contains(s, ' and the ') or regexp_matches(s, ' the [^ ]* with ') or {has('modern')}",
    "match_prefix": some_word("starts_with(x, 'ung')"),
    "match_wildcard": some_word(
        "(x like '%heitkeit' or x like 'th_nt%' or x like '%ßü%' or x like 'a%ti_n' or x like 'ver%')"
    ),
    # The words are looked at once each, not once an article.
    "match_fuzzy": "list_has_any(w, (select list(x) from (select distinct unnest(w) as x from worded) where x <> '' and ("
    + " or ".join(near("x", _text(w), n) for w, n in (("ander", 1), ("heitkeit", 2), ("oionai", 2)))
    + ")))",
    "match_title": "list_contains(tw, 'the') or contains(ts, ' de la ') or regexp_matches(ts, ' la ')",
}

FIELDS = ("article_dc_title", "paper_dc_title", "text_content")
DOC_TERMS = "select identifier, field, term, count(*) as tf from (" + " union all ".join(
    f"select identifier, '{f}' as field, unnest({analyzed(f)}) as term from {{source}}" for f in FIELDS
) + ") group by identifier, field, term"


def _choose(key: str, values: tuple[str, ...]) -> str:
    cases = " ".join(f"when {key} % {len(values)} = {i} then {_text(v)}" for i, v in enumerate(values))
    return f"case {cases} end"


BY_LENGTH = (
    f"list_transform(list_sort(list_transform(list_distinct({analyzed('text')}), "
    "lambda x: struct_pack(n := -length(x), w := x))), lambda x: x.w)"
)
PICKED = """list_value(l[1], l[1 + (len(l) - 1) // 2], l[len(l)], l[1 + (len(l) - 1) // 4])"""
MIDDLE = "trim(array_to_string(list_slice(q, greatest((len(q) - 3) // 2, 0) + 1, greatest((len(q) - 3) // 2, 0) + 3), ' '))"

QUERIES = f"""passage_words as (
  select item_id, {PICKED} as a, {MIDDLE} as p
  from (select item_id, {BY_LENGTH} as l, {positions("text")} as q from benchmark)),
stored as (
  select cast(item_id as integer) as id, array_to_string(list_slice(a, 1, 3), ' ') as query,
    make_date(1850 + item_id % 40, 1, 1) as date_lower, make_date(1920 + item_id % 70, 12, 31) as date_upper,
    {_choose("item_id", TYPE_LISTS)} as types, {_choose("item_id", DISTRIBUTION_LISTS)} as places,
    cast(item_id % 6 as integer) as user_id
  from passage_words)"""

LABELS = """labels_of(kind, code, label) as (values
  ('distribution', 'sd_national', 'Landelijk'), ('distribution', 'sd_regional', 'Regionaal/lokaal'),
  ('distribution', 'sd_antilles', 'Nederlandse Antillen'), ('distribution', 'sd_surinam', 'Suriname'),
  ('distribution', 'sd_indonesia', 'Nederlands-Indië / Indonesië'),
  ('article_type', 'st_article', 'artikel'), ('article_type', 'st_advert', 'advertentie'),
  ('article_type', 'st_illust', 'illustratie met onderschrift'), ('article_type', 'st_family', 'familiebericht'))"""

EXCLUDED = """excluded as (
  select c.id, c.kind, c.code, l.label
  from (select id, 'article_type' as kind, unnest(string_split(types, '+')) as code from stored
        union all select id, 'distribution', unnest(string_split(places, '+')) from stored) c
  left join labels_of l on c.kind = l.kind and c.code = l.code
  where c.code <> '')"""

# One leaf a row; ``hit`` decides an article from its leaves by the form of the query.
BATCH_TABLES = f"""{WORDED}, {QUERIES}, {LABELS}, {EXCLUDED},
passages as (select cast(item_id as integer) as query_id, item_id % 6 as form, a, p from passage_words),
article_words as (select identifier, unnest(list_distinct(w)) as word from worded),
title_words as (select identifier, unnest(list_distinct(tw)) as word from worded),
"""
LEAVES = f"""leaf as (
  select query_id, form, 1 as n, a[1] as word from passages where form in (0, 1, 2)
  union all select query_id, form, 2, a[2] from passages where form in (0, 1)
  union all select query_id, form, 3, a[3] from passages where form = 0
  union all select query_id, form, 4, a[4] from passages where form = 2),
leaf_hit as (
  select query_id, form, n, identifier from leaf join article_words using (word) where word <> ''
  union all
  select query_id, form, 1, identifier from passages, worded
  where form = 3 and p <> '' and regexp_matches(s, ' ' || regexp_replace(p, '  ', ' [^ ]* ') || ' ')
  union all
  select query_id, form, 1, identifier from (
    select distinct query_id, form, word from passages, (select distinct word from article_words)
    where form = 4 and word <> '' and (word like a[1][1:4] || '%' or word like a[2][1] || '_' || a[2][3:])
      or form = 5 and word <> '' and {near('word', 'a[1]', 1)}) join article_words using (word)
  union all
  select query_id, form, 2, identifier from passages join title_words on word = a[2] where form = 5),
decided as (
  select query_id, identifier from (
    select query_id, form, identifier, bool_or(n = 1) as h1, bool_or(n = 2) as h2, bool_or(n = 4) as h4
    from leaf_hit group by query_id, form, identifier)
  where case form when 1 then h1 and h2 when 2 then h1 and not h4 else true end),
"""
PATTERNS = f"""pattern_words as (
  select distinct query_id, word from passages, (select distinct word from article_words where word <> '')
  where case query_id % 4 when 0 then true when 1 then length(word) = 5
    when 2 then length(word) <= 4 and {near('word', 'left(a[2], 2)', 2)}
    else contains(word, substr(a[1], 2, 3)) end),
decided as (select distinct query_id, identifier from pattern_words join article_words using (word)),
"""
COUNTED = f"""matches as (
  select d.query_id, d.identifier from decided d
  join stored q on q.id = d.query_id join worded x on x.identifier = d.identifier
  where x.paper_dc_date between q.date_lower and q.date_upper
    and not exists (select 1 from excluded e where e.id = q.id
      and e.label = case e.kind when 'distribution' then x.paper_dcterms_spatial else x.article_dc_subject end)),
counted as (
  select s.id as query_id, count(m.identifier) as count
  from stored s left join matches m on m.query_id = s.id group by s.id),
gated as (
  select query_id, count, case when count <= 0 or count < 3 then 'too_few' when count > 200 then 'too_many' else 'ok' end as status
  from counted)"""

BATCH = BATCH_TABLES + LEAVES + COUNTED
PATTERN_BATCH = BATCH_TABLES + PATTERNS + COUNTED

DAY = "strftime(o_orderdate, '%Y-%m-%d')"
XML_COLUMNS = """'article:' || doc_id as identifier, source as paper_dc_title, 'A & B ' || doc_id as article_dc_title,
  date '1850-01-01' + cast((doc_id * 7919) % 51499 as integer) as paper_dc_date,
  case when doc_id % 23 = 0 then '' else array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10)) end as text_content,
  'article' as article_dc_identifier_resolver, 'article:' || doc_id as article_dcx_recordIdentifier, true as from_archive"""
XML_OK = "doc_id % 17 <> 0 and doc_id % 19 <> 0"


def oracle_sql() -> dict[str, str]:
    word_count = "select term, count(*) as count from"
    out = {
        "corpus_scan_filtered": f"with {ARTICLES} select identifier, article_dc_title, text_content from articles where {IN_DATES} and {NOT_PLACES}",
        "matching_ids": f"with {SELECTED} select identifier from selected",
        "saved_query_scan": f"with {QUERIES} select id, query, date_lower, date_upper, replace(types, '+', '|') as exclude_article_type, replace(places, '+', '|') as exclude_distributions, user_id from stored",
        "id_pages": f"with {ARTICLES} select identifier, cast(floor((row_number() over (order by identifier) - 1) / 64) as bigint) as page from articles",
        "page_offset": f"with {ARTICLES} select identifier from articles order by identifier limit 30 offset 30",
        "page_late": f"with {ARTICLES} select identifier from articles order by identifier limit 40 offset 150",
        "saved_query_order": f"with {QUERIES} select id, row_number() over (order by md5('7:' || id), id) - 1 as place from stored",
        "stored_term_counts": f"with {ARTICLES} select term, count(distinct identifier) as documents, cast(sum(tf) as bigint) as count from ({DOC_TERMS.replace('{source}', 'articles')}) where term in ('the', 'heit', 'keit', 'les', 'and', 'zzyzx') group by term",
        "stored_wordcloud": f"with {SELECTED} {word_count} (select unnest({analyzed(CLOUD_TEXT)}) as term from selected) where length(term) >= 2 group by term",
        "doc_terms_by_ids": f"with {SELECTED} {DOC_TERMS.replace('{source}', 'selected')}",
        "multivalue_first": "select doc_id, string_split(text, chr(10))[1] as first_value from documents",
        "xml_ingest": f"select {XML_COLUMNS} from documents where {XML_OK}",
        "incremental_ingest": f"select {XML_COLUMNS} from documents where {XML_OK}",
        "xml_quarantine": "select case when doc_id % 17 = 0 then 'malformed' else 'missing_field' end as status, count(*) as docs from documents where doc_id % 17 = 0 or doc_id % 19 = 0 group by 1",
        "bulk_roundtrip": f"with {ARTICLES} select * exclude (doc_id) from articles",
        "corpus_load": f"with {ARTICLES} select identifier, paper_dc_date, article_dc_subject, paper_dcterms_spatial, article_dc_title, text_content from articles where {IN_DATES}",
        "paragraph_join": "select doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: x <> ''), chr(10) || chr(10)) as text_content from documents",
        "html_unescape_basic": "select page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') as html from pages",
        "file_stem": "select doc_id, 'issue.' || doc_id || '.xml' as stem, 'issue.' || doc_id || '.xml.json.gz' as bulk_name from documents",
        "split_exclusions": f"with {QUERIES} select cast(id as bigint) as id, case when places = '' then 0 else len(string_split(places, '+')) end as codes, replace(places, '+', '|') as code_list from stored",
        "run_label": "select doc_id, source || '@' || lang as label from documents",
        "parse_date": f"select o_orderkey, case when o_orderkey % 3 = 2 then null else cast({DAY} as date) end as parsed from orders",
        "wordcount_raw": count_of(raw("text"), "documents"),
        "counts_sink": count_of(raw("text"), "documents"),
        "wordcount_clean": count_of(stripped("text", 2), "documents"),
        "streaming_wordcount": count_of(stripped("text", 2), "documents"),
        "analyzed_terms": count_of(analyzed("text"), "documents"),
        "tokens_per_doc": f"with {ARTICLES} select identifier, cast(len({stripped('text_content')}) + len({stripped('article_dc_title')}) as bigint) as tokens from articles",
        "doc_terms": f"with {ARTICLES} {DOC_TERMS.replace('{source}', 'articles')}",
        "merge_counts": f"with {ARTICLES} {word_count} (select unnest({stripped('article_dc_title', 2)}) as term from articles union all select unnest({stripped('text_content', 2)}) from articles) group by term",
        "corpus_stats": f"with {ARTICLES}, n as (select sum(len({stripped(CLOUD_TEXT)})) as words, count(*) as docs from articles) select 'nrWords' as key, cast(words as bigint) as value from n union all select 'nrDocs', cast(docs as bigint) from n",
        "corpus_stats_avg": f"with {SELECTED} select cast(sum(len({stripped(CLOUD_TEXT)})) as double) / cast(count(*) as double) as words_per_doc from selected",
        "articles_per_source": "select source, count(*) as articles, false as total from documents group by source union all select null, count(*), true from documents",
        "filter_date_range": f"with {ARTICLES} select identifier, paper_dc_date from articles where {IN_DATES}",
        "filter_exclude": f"with {ARTICLES} select identifier, article_dc_subject, paper_dcterms_spatial from articles where {NOT_PLACES} and {NOT_TYPES}",
        "filtered_query": f"with {SELECTED} select identifier, paper_dc_date, article_dc_subject, paper_dcterms_spatial, article_dc_title from selected",
        "count_matches": f"with {SELECTED} select count(*) as count from selected",
        "wordcloud_mr": f"with {SELECTED} {word_count} (select unnest({stripped(CLOUD_TEXT, 2)}) as term from selected) group by term order by count desc, term limit 100",
        "running_wordcloud": f"with {SELECTED} select *, row_number() over (order by count desc, term) as rank from ({word_count} (select unnest({stripped(CLOUD_TEXT, 2)}) as term from selected) group by term order by count desc, term limit 100)",
        "wordcloud_tv": f"with {SELECTED} {word_count} (select unnest({analyzed(CLOUD_TEXT)}) as term from selected) where length(term) >= 2 group by term",
        "wordcloud_stopwords": f"with {ARTICLES} {word_count} (select unnest({stripped(CLOUD_TEXT, 2)}) as term from articles) where term not in (select unnest({analyzed('text')}) from benchmark) group by term",
        "wordcloud_response": f"with {SELECTED}, top as ({word_count} (select unnest({stripped(CLOUD_TEXT, 2)}) as term from selected) group by term order by count desc, term limit 100) select max(count) as max_count, cast(to_json(list(struct_pack(term := term, count := count) order by count desc, term)) as varchar) as result, 'ok' as status, false as burstcloud from top",
        "query_json": f"with {QUERIES} select id, cast(to_json(struct_pack(id := id, query := query, date_lower := date_lower, date_upper := date_upper, exclude_article_type := list_filter(string_split(types, '+'), lambda x: x <> ''), exclude_distributions := list_filter(string_split(places, '+'), lambda x: x <> ''), user_id := user_id)) as varchar) as json from stored",
        "decode_exclusions": f"with {QUERIES}, {LABELS}, {EXCLUDED} select id, kind, code, label from excluded",
        "saved_query_counts": f"with {BATCH} select query_id, count from counted",
        "bucketed_query_counts": f"with {BATCH} select query_id, count from counted",
        "query_size_gate": f"with {BATCH} select query_id, status from gated",
        "saved_query_wordcloud": f"with {BATCH} select * from (select *, row_number() over (partition by query_id order by count desc, term) as rank from (select query_id, term, count(*) as count from (select m.query_id, unnest({analyzed(CLOUD_TEXT)}) as term from matches m join gated using (query_id) join worded x on x.identifier = m.identifier where status = 'ok') where length(term) >= 2 group by query_id, term)) where rank <= 100",
        "result_log": f"with {BATCH} select 'run@documents' as identifier, query_id as queryid, status, count, true as timed from gated",
        "saved_query_patterns": f"with {PATTERN_BATCH} select query_id, count from counted",
        "saved_query_wordcloud_mr": f"with {BATCH} select * from (select *, row_number() over (partition by query_id order by count desc, term) as rank from (select query_id, term, count(*) as count from (select m.query_id, unnest({stripped(CLOUD_TEXT, 2)}) as term from matches m join worded x on x.identifier = m.identifier) group by query_id, term)) where rank <= 100",
        "saved_query_wordcloud_all": f"with {BATCH} select * from (select *, row_number() over (partition by query_id order by count desc, term) as rank from (select query_id, term, count(*) as count from (select m.query_id, unnest({analyzed(CLOUD_TEXT)}) as term from matches m join worded x on x.identifier = m.identifier) where length(term) >= 2 group by query_id, term)) where rank <= 100",
        "saved_query_stats": f"with {BATCH}, sized as (select identifier, len({stripped('text_content')}) + len({stripped('article_dc_title')}) as words from worded) select s.id as query_id, cast(coalesce(sum(words), 0) as bigint) as words, count(z.identifier) as docs from stored s left join matches m on m.query_id = s.id left join sized z on z.identifier = m.identifier group by s.id",
        "match_diacritics": f"with {DECOMPOSED} select identifier from worded where {has(_ET)} or regexp_matches(s, {_text(f' r{_E} [^ ]* la ')}) or {some_word('regexp_matches(x, ' + _text(f'^que.{_E}.*$') + ')')}",
        "ingest_report": f"select count_if({XML_OK}) as articles, count_if(not ({XML_OK})) as rejected, 0 as unreadable from documents",
        "bulk_quarantine": "select case when doc_id % 13 = 0 then '{\"broken ' || doc_id else '{\"no_id\":' || doc_id || '}' end as line from documents where doc_id % 13 = 0 or doc_id % 29 = 0",
    }
    for name, test in MATCHES.items():
        out[name] = f"with {WORDED} select identifier from worded where {test}"
    return out
