"""The SQL each query is compared with, in DuckDB's dialect, over the same tables."""

from __future__ import annotations

from checks.inputs import DATES, FEEDBACK, HOT_REQUESTS, HOT_STORED, ITEMS, LINKS, REQUESTS, TASKS

ORACLES: dict[str, str] = {}

SPACES = r"\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACES}]+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')"


def no_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', '', 'g')"


def basic_entities(x: str) -> str:
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


def unescape(x: str) -> str:
    """Entities that occur in the pages; the ampersand last, so nothing is decoded twice."""
    for entity, char in (("&nbsp;", "\xa0"), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">")):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def clean(x: str) -> str:
    return collapse(f"nfc_normalize({no_tags(unescape(x))})")


def price(x: str) -> str:
    s = f"regexp_replace({x}, '[^0-9.,]', '', 'g')"
    return f"""try_cast(case
      when contains({s}, ',') and contains({s}, '.') then
        case when strpos(reverse({s}), '.') < strpos(reverse({s}), ',') then replace({s}, ',', '')
          else replace(replace({s}, '.', ''), ',', '.') end
      when contains({s}, ',') then
        case when strpos(reverse({s}), ',') <= 3 then replace({s}, ',', '.') else replace({s}, ',', '') end
      else {s} end as double)"""


def rating(x: str) -> str:
    n = f"try_cast(regexp_extract({x}, '([0-9.]+)', 1) as double)"
    return f"""case
      when lower({x}) like '%out of 5%' or {x} like '%/5%' or {x} like '%5' then {n}
      when lower({x}) like '%out of 10%' or {x} like '%/10%' or {x} like '%10' then {n} / 2
      when lower({x}) like '%out of 100%' or {x} like '%/100%' or {x} like '%100' or contains({x}, '%') then {n} / 20
      else {n} end"""


def link(x: str) -> str:
    s = strip(x)
    return f"case when {s} = '' or {s} like 'http://%' or {s} like 'https://%' then {s} else 'https://' || {s} end"


def date(x: str) -> str:
    s = strip(x)
    formats = (
        "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y", "%m-%d-%Y", "%b %d, %Y", "%B %d, %Y", "%d %b %Y",
        "%d %B %Y", "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S.%fZ",
    )
    parsed = "coalesce(" + ", ".join(f"try_strptime({s}, '{f}')" for f in formats) + ")"
    ymd, dmy = "([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})", "([0-9]{1,2})[-/]([0-9]{1,2})[-/]([0-9]{4})"

    def part(pattern, group):
        return f"lpad(regexp_extract({s}, '{pattern}', {group}), 2, '0')"

    year = f"regexp_extract({s}, '{ymd}', 1)"
    late = f"regexp_extract({s}, '{dmy}', 3)"
    return f"""coalesce(
      strftime({parsed}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({parsed}) % 1000000 = 0 then '' else strftime({parsed}, '.%f') end,
      case when regexp_matches({s}, '{ymd}')
        then strftime(try_cast({year} || '-' || {part(ymd, 2)} || '-' || {part(ymd, 3)} as date), '%Y-%m-%dT00:00:00')
        else strftime(try_cast({late} || '-' || {part(dmy, 2)} || '-' || {part(dmy, 1)} as date), '%Y-%m-%dT00:00:00') end,
      {s})"""


def _part(x: str, group: int) -> str:
    pattern = r"^\s*(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
    got = f"regexp_extract({x}, '{pattern}', {group})"
    return f"lower({got})" if group == 1 else got


def rebuilt(x: str, query: str) -> str:
    return f"""{_part(x, 1)} || '://' || {_part(x, 2)} || {_part(x, 3)}
      || case when {query} = '' then '' else '?' || {query} end
      || case when {_part(x, 5)} = '' then '' else '#' || {_part(x, 5)} end"""


def pair_rows(source: str, key: str, query: str, keep_blank: bool) -> str:
    """CTEs from a table with ``key`` and a query string to one row per decoded value."""
    blank = "" if keep_blank else "where raw_value <> ''"
    return f"""segments as (
        select {key}, unnest(string_split({query}, '&')) as seg, generate_subscripts(string_split({query}, '&'), 1) as n from {source}),
      raws as (
        select {key}, n, split_part(seg, '=', 1) as raw_key,
          case when contains(seg, '=') then substr(seg, strpos(seg, '=') + 1) else '' end as raw_value
        from segments where seg <> ''),
      pairs as (
        select {key}, n, url_decode(replace(raw_key, '+', ' ')) as k, url_decode(replace(raw_value, '+', ' ')) as v from raws {blank}),
      ranked as (select *, min(n) over (partition by {key}, k) as first_n from pairs)"""


FLAT_CATALOGUE = """select task_id, 'title' as field, 'h1' as selector,
  case when page_id % 3 <> 0 then 'nav a' end as next_selector,
  cast(page_id as double) + 1700000000.5 as generated_at, url, data_description"""

H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1)"
TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"
AD = "regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"
HREFS = "list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), 'href=\"([^\"]*)\"', 1), lambda x: " + unescape("x") + ")"
LABELS = "list_transform(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1), lambda x: " + unescape("x") + ")"
HOST = "split_part(split_part(split_part(split_part(url, '//', 2), '/', 1), '?', 1), '#', 1)"
BASE = f"split_part(url, '//', 1) || '//' || {HOST}"


def _set(**texts: str) -> None:
    ORACLES.update(texts)


# -- A ------------------------------------------------------------------------------
_set(
    a1_page_scan="select page_id, url, length(html) as n_chars from pages",
    a2_catalogue_scan=f"{FLAT_CATALOGUE} from ({TASKS})",
    a3_feedback_scan=FEEDBACK,
    a4_record_scan=ITEMS,
    a4_bad_rows=f"""select case when id % 7 <> 0 then id end as id,
      case when id % 7 = 0 then left('{{"id":' || id || ',"name":"' || name || '"', 20) end as bad from ({ITEMS})""",
    a2_broken_files="select page_id % 5 <> 0 as readable, page_id % 5 = 0 as to_generate, count(*) as n from pages group by 1, 2",
    a5_json_scan="select cast(json_extract(props, '$.k') as bigint) as k, count(*) as n, cast(0 as bigint) as bad from events group by 1",
)

# -- B ------------------------------------------------------------------------------
_set(
    b1_container_items=f"""select page_id, cast(unnest(range(len({HREFS}))) as integer) as item,
      trim(unnest({LABELS})) as label, unnest({HREFS}) as href from pages""",
    b2_single_item=f"select page_id, trim({unescape(TITLE)}) as title, trim({unescape(H1)}) as h1, cast(null as varchar) as video from pages",
    b3_one_and_all=f"""select page_id, {HREFS}[1] as one, array_to_string({HREFS}, '|') as many,
      len({HREFS}) as n_many, cast(0 as bigint) as n_none from pages""",
    b4_value_kinds=f"""select page_id, trim({unescape(AD)}) as shown,
      '<div class="ad">' || replace(replace({unescape(AD)}, '&', '&amp;'), '>', '&gt;') || '</div>' as markup,
      'ad' as klass, trim({unescape(AD)}) as inner, '' as no_src, 'utf-8' as charset, 'p{{margin:0}}' as style,
      trim({unescape(AD)}) as other from pages""",
    b4_article_text=f"""select page_id, array_to_string(list_transform(list_transform(
        regexp_split_to_array(regexp_extract(html, '<article>(.*)</article>', 1), '<[^>]+>'), lambda x: {unescape("x")}),
        lambda x: {strip("x")}), '') as article,
      len(regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1), '<p>')) as n from pages""",
    b1_unusable_rules=f"""select task_id, case when page_id % 2 = 0 then 'f' || page_id else 'container' end as name,
      case when page_id % 2 = 0 then 'p:hover' else 'li:nth-child(2 of .x)' end as selector, page_id % 2 = 1 as is_container from ({TASKS})""",
    b5_next_by_link=f"select page_id, {BASE} || {HREFS}[1] as next_url from pages",
    b6_next_by_button=f"""select page_id, case when page_id % 2 = 0
        then {BASE} || regexp_replace({_part("url", 3)}, '/?[^/]*$', '') || '/p' || page_id || '.html'
        else {BASE} || '/root/' || page_id end as next_url from pages""",
    b7_next_by_parameter=f"""with source as (select page_id, url, {_part("url", 4)} as q from pages),
      {pair_rows("source", "page_id", "q", False)},
      mine as (select page_id, try_cast(any_value(v order by n) as bigint) as at from pairs where k = 'page' group by page_id),
      parts as (
        select page_id, first_n, n, case when k = 'page' then null else
          replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+') end as part from ranked),
      rest as (select page_id, string_agg(part, '&' order by first_n, n) as text,
          bool_or(part is null) as has_page from parts group by page_id),
      joined as (
        select s.page_id, s.url,
          (select string_agg(coalesce(part, 'page=' || (m.at + 1)), '&' order by first_n, n) from parts p where p.page_id = s.page_id)
          as found, coalesce(r.has_page, false) as has_page from source s left join mine m using (page_id) left join rest r using (page_id))
      select page_id, {rebuilt("url", "(case when has_page then found when found is null then 'page=2' else found || '&page=2' end)")} as next_url from joined""",
    b8_pagination_walk="""select p.page_id as task, n as page_no, p.page_id + n - 1 as page_id
      from pages p, range(1, 4) r(n) where exists (select 1 from pages q where q.page_id = p.page_id + n - 1)""",
)

# -- C ------------------------------------------------------------------------------
_typed = f"""id, {strip("name")} as name, {price("price")} as price, {rating("rating")} as rating,
  {link("link")} as link, {no_tags(basic_entities(collapse("description")))} as description"""
_set(
    c1_process=f"select {_typed}, '2024-01-01T00:00:00' as processed_at, '1.0.0' as version from ({ITEMS})",
    c2_dispatch=f"""select id, {strip("name")} as candidate, {no_tags(basic_entities(collapse("name")))} as context,
      {rating("name")} as operating, {link("name")} as image_url, {price("name")} as "unitPrice", {strip("name")} as headline from ({ITEMS})""",
    c3_price=f"select id, {price('price')} as price from ({ITEMS})",
    c4_date=f"select id, {date('published_date')} as published_date from ({DATES})",
    c5_text=f"select page_id, {no_tags(basic_entities(collapse('html')))} as body_text from pages",
    c6_url=f"select id, {link('link')} as link from ({ITEMS})",
    c7_rating=f"select id, {rating('rating')} as rating from ({ITEMS})",
    c8_list=f"""select id, {strip("name")} || '|' || {strip("description")} as tags, cast(null as double) as prices,
      '[''' || name || ''', ''' || rating || ''']' as links from ({ITEMS})""",
    c9_default=f"select id, trim(name) as name from ({ITEMS})",
    c10_metadata="select c_custkey, '2024-01-01T00:00:00' as processed_at, '1.0.0' as processor_version from customer",
)

# -- D ------------------------------------------------------------------------------
_merged = """select coalesce(c.c_custkey, s.id) as id, coalesce(s.name, c.c_name) as name, c.c_acctbal as balance, s.nation as nation,
  c.c_mktsegment as segment, s.kind as kind
  from customer c full outer join (select s_suppkey * 2 as id, case when s_suppkey % 2 = 0 then s_name end as name,
    s_nationkey as nation, 'supplier' as kind from supplier) s on c.c_custkey = s.id"""
_set(
    d1_consolidate=f"""select coalesce(case when id % 2 = 0 then name end, case when id % 3 = 0 then 'Heading' end) as title,
      description, coalesce(price, '9') as price, link as url, rating, id from ({ITEMS})""",
    d2_dedupe="""select event_id, user_id, event_type, value from events
      qualify row_number() over (partition by user_id, event_type order by event_id) = 1""",
    d2_map_keys="select min(event_id) as event_id, cast(event_id % 3 as varchar) as a from events group by event_id % 3",
    d1_number_beside_text=f"""select id, case when id = 0 then '0.0' when id % 2 = 0 then id || '000000.0' else 'about ' || id end as price,
      case when id % 2 = 0 then id * 1000000.0::double end as number from ({ITEMS})""",
    d2_dedupe_guessed=f"""select id as _ord, name, rating from ({ITEMS})
      qualify row_number() over (partition by name, rating order by id) = 1""",
    d3_filter="""select p_partkey, p_name, p_brand, p_size from part
      where p_size between 5 and 40 and contains(p_name, 'ring') and regexp_matches(p_brand, '#1[0-9]?$')""",
    d4_sort=f"select id, price, row_number() over (order by lower(price) desc nulls last, id) - 1 as place from ({ITEMS})",
    d5_top="select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 25",
    d6_union="""select c_custkey as key, c_name as name, c_mktsegment, cast(null as double) as s_acctbal from customer
      union all select s_suppkey, s_name, null, s_acctbal from supplier""",
    d7_merge=_merged,
    d8_flatten=f"select id, name as info_name, balance as info_balance, nation as info_nation, segment, kind from ({_merged})",
    d9_chunks="select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 1000 as chunk from orders",
)

# -- E ------------------------------------------------------------------------------
_set(
    e1_clean=f"""select nullif({clean(strip("name"))}, '') as title, {price("price")} as price, {rating("rating")} as rating,
      nullif({clean(link("link"))}, '') as url, nullif({clean(no_tags(basic_entities(collapse("description"))))}, '') as description,
      '2024-01-01T00:00:00' as processed_at from ({ITEMS})""",
    e2_clean_nested=f"""select id, nullif({clean("name")}, '') as name, nullif({clean("description")}, '') as description,
      cast(null as varchar) as gone, true as is_empty, description as raw from ({ITEMS})""",
    e2_nested_raw=f"""select id, '<b>x</b> &amp; ' || name as raw, {collapse("'x & ' || name")} as shown, '<b>x</b> &amp; ' || name as part_raw,
      cast(null as varchar) as gone, {collapse("'x & ' || name")} as part_shown, {collapse("'x & ' || name")} as k, '<b>x</b> &amp; ' || name as map_raw,
      cast(2 as bigint) as n, true as is_empty from ({ITEMS})""",
    e3_large_types="""select p_partkey, large, 'a é fi 1 F1 ' || p_name as text, 'a é fi 1 F1 ' || p_name as part
      from part, (select unnest(['false', 'true']) as large)""",
    e5_case_variant=f"select id, case when id % 3 = 0 then 'h' else name end as title from ({ITEMS})",
    e7_long_text=f"""with words as (
        select doc_id, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n from (
          select doc_id, string_split({collapse("replace(text, 'ß', 's')")}, ' ') as w from documents where text is not null)),
      cased as (
        select doc_id, pos, case
          when pos not in (1, n) and lower(word) in ('a','an','the','and','but','or','for','nor','on','at','to','from','by','of','in','with','as')
            and not (word = upper(word) and word <> lower(word)) then lower(word)
          when pos not in (1, n) and word = upper(word) and word <> lower(word) and length(word) <= 5 then word
          else upper(left(word, 1)) || lower(substr(word, 2)) end as word from words)
      select doc_id, md5(string_agg(word, ' ' order by pos)) as title from cased group by 1""",
    e3_clean_string=f"select page_id, {clean('html')} as shown from pages",
    e3_clean_documents=f"select doc_id, {clean('text')} as text from documents",
    e4_clean_list=f"select id, {clean('name')} || '|' || {clean('description')} as parts, cast(2 as bigint) as n from ({ITEMS})",
    e5_standardise=f"select id as sku, coalesce(case when id % 4 = 0 then 'H' end, name) as title, price, rating, rating as stars from ({ITEMS})",
    e6_remove_empty=f"""select name, price from (select case when id % 3 = 1 then name end as name, case when id % 2 = 0 then price end as price
      from ({ITEMS})) where name is not null or price is not null""",
    e7_title_case="""with words as (
        select p_partkey, unnest(w) as word, generate_subscripts(w, 1) as pos, len(w) as n from (
          select p_partkey, string_split(p_name || ' OF the ' || p_type || ' LONGWORD ' || p_name, ' ') as w from part)),
      cased as (
        select p_partkey, pos, case
          when pos not in (1, n) and lower(word) in ('a','an','the','and','but','or','for','nor','on','at','to','from','by','of','in','with','as')
            and word <> upper(word) then lower(word)
          when pos not in (1, n) and word = upper(word) and word <> lower(word) and length(word) <= 5 then word
          else upper(word[1]) || lower(word[2:]) end as word from words)
      select p_partkey, string_agg(word, ' ' order by pos) as title from cased group by 1""",
    e8_clean_prices=f"""select id, cast(printf('%.2f', {price("price")}) as double) as price, case when {price("price")} is null then price end as price_raw,
      cast(printf('%.2f', id / 8.0) as double) as cost from ({ITEMS})""",
    e9_clean_urls=f"select id, replace({link('link')}, ' ', '%20') as link from ({ITEMS})",
    e10_clean_html=f"select id, {collapse(unescape(no_tags('description')))} as description from ({ITEMS})",
)

# -- F ------------------------------------------------------------------------------
_nested = "case when contains(v, '&') and contains(v, '=') then replace(v, '&', '%26') else v end"
_links = f"with source as (select page_id, trim(url) as url, {_part('url', 4)} as q from ({LINKS}))"
_set(
    f1_sanitise=f"""{_links}, {pair_rows("source", "page_id", "q", True)},
      built as (select page_id, string_agg(url_encode(k) || '=' || url_encode({_nested}), '&' order by first_n, n) as text from ranked group by 1)
      select page_id, {rebuilt("url", "coalesce(text, '')")} as url from source left join built using (page_id)""",
    f2_query_params=f"""{_links}, {pair_rows("source", "page_id", "q", True)}
      select page_id, k as key, row_number() over (partition by page_id, k order by n) - 1 as nth, {_nested} as value from ranked""",
    f3_build_query="""select p_partkey, 'q%20w=' || url_encode(p_name) || '&q%20w=' || url_encode(p_type) || '&b=' || url_encode(p_brand)
      as query from part""",
    f4_append_param=f"""{_links}, {pair_rows("source", "page_id", "q", False)},
      parts as (select page_id, first_n, n, k, case when k = 'page' then 'page=n+' || page_id
          else replace(url_encode(k), '%20', '+') || '=' || replace(url_encode(v), '%20', '+') end as part from ranked where k <> 'page' or n = first_n),
      built as (select page_id, string_agg(part, '&' order by first_n, n) || case when bool_or(k = 'page') then '' else '&page=n+' || page_id end as text
        from parts group by page_id)
      select page_id, {rebuilt("url", "coalesce(text, 'page=n+' || page_id)")} as url from source left join built using (page_id)""",
    f5_base_url=f"select page_id, {BASE} as base from pages",
    f6_domain=f"select {HOST} as domain, count(*) as pages from pages group by 1",
    f7_join_url=f"""with source as (select page_id, regexp_replace(url, '[?#].*$', '') as base, regexp_replace({_part("url", 3)}, '/$', '') as path from pages)
      select page_id, case page_id % 4 when 2 then 'http://else.example.com/'
        when 0 then regexp_replace(base, '/$', '') || '/top'
        when 1 then regexp_extract(base, '^[a-z]+://[^/]*', 0) || regexp_replace(path, '/[^/]*$', '') || '/up/x'
        else regexp_replace(base, '/$', '') || '/a/b?c=d' end as url from source""",
    f8_bare_domain=f"select page_id, regexp_replace({HOST}, '^www\\.', '') as domain from pages",
    f9_is_url=f"""select url, true as is_url from pages union all
      select link, link like 'https://%' from ({ITEMS})""",
    f10_split_domain=f"select id, split_part(string_split(link, '//')[-1], '/', 1) as domain from ({ITEMS})",
)

# -- G ------------------------------------------------------------------------------
_set(
    g1_task_id="select doc_id, md5(text) as hash, md5(source || '_' || text) as task_id from documents",
    g2_safe_id=r"select page_id, regexp_replace(url, '[^\p{L}\p{N}]', '_', 'g') as safe from pages",
    g3_file_name=r"""with raw as (select doc_id, trim(regexp_replace(' .' || text || '.txt', '[\\/*?:"<>|]', '_', 'g'), '. ') as s from documents)
      select doc_id, case when length(s) > 255 then left(left(s, length(s) - 4), 250) || '.txt' else s end as file_name from raw""",
    g4_truncate="select doc_id, case when length(text) <= 80 then text else left(text, 77) || '...' end as text from documents",
    g5_format_timestamp=f"""select timestamp, strftime(epoch_ms(cast(floor(timestamp) as bigint) * 1000), '%Y-%m-%d %H:%M:%S') as shown from ({FEEDBACK})""",
    g6_elapsed="""select event_id, case when s < 60 then printf('%.2f seconds', s) when s < 3600 then printf('%.2f minutes', s / 60)
      else printf('%.2f hours', s / 3600) end as elapsed from (select event_id, cast(event_id as double) * 1.25 as s from events)""",
)

# -- H ------------------------------------------------------------------------------
_rated = f"""select t.task_id, t.page_id, t.url, t.data_description, cast(e.event_id % 10 + 1 as integer) as rating,
  'saw ' || e.event_type as feedback, cast(e.event_id as double) as timestamp
  from ({TASKS}) t join events e on e.user_id = t.page_id"""
_set(
    h1_store=f"""select md5(url || '_' || data_description) as task_id, url, data_description,
      case when rating < 8 then rating end as rating, feedback, timestamp from ({FEEDBACK})""",
    h2_for_task=f"""select url, data_description, rating, feedback, timestamp, row_number() over (order by timestamp desc) - 1 as place from ({FEEDBACK})
      where task_id = '01993059f0f2eb1fef51f0bf3749f2e0'""",
    h3_for_domain=f"select *, row_number() over (order by timestamp desc) - 1 as place from ({FEEDBACK}) where url like '%ite4.example%'",
    h4_average=f"select coalesce(avg(rating), 0.0) as average_rating from ({FEEDBACK})",
    h4_average_by_task=f"select task_id, coalesce(avg(rating), 0.0) as average_rating, count(rating) as ratings from ({FEEDBACK}) group by 1",
    h4_average_by_domain=f"""select split_part(split_part(url, '//', 2), '/', 1) as domain, coalesce(avg(rating), 0.0) as average_rating,
      count(rating) as ratings from ({FEEDBACK}) group by 1""",
    h5_recent=f"select * from ({FEEDBACK}) order by timestamp desc, task_id limit 10",
    h6_issues=f"""select issue, count(*) as entries from ({FEEDBACK}),
      (select unnest(['missing data','wrong data','incomplete','error','slow','timeout','blocked','captcha','wrong format','duplicate','empty','not working']) as issue)
      where contains(lower(feedback), issue) group by 1""",
    h7_to_refine=f"""select task_id, rating, timestamp, case when page_id % 3 <> 0 then 'nav a' end as next_selector
      from ({_rated}) where rating < 5""",
)

# -- I ------------------------------------------------------------------------------
def _similar(requests: str, tasks: str) -> str:
    return f"""with asked as (
        select request_id, split_part(string_split(url, '//')[-1], '/', 1) as domain,
          list_distinct(list_filter(string_split({collapse("lower(data_description)")}, ' '), lambda x: x <> '')) as words from ({requests})),
      stored as (
        select task_id, split_part(string_split(url, '//')[-1], '/', 1) as domain,
          list_distinct(list_filter(string_split({collapse("lower(data_description)")}, ' '), lambda x: x <> '')) as words from ({tasks})),
      scored as (
        select request_id, task_id, len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) as score
        from asked a join stored b using (domain))
      select request_id, task_id as match_task_id, score from scored where score > 0.5
      qualify row_number() over (partition by request_id order by score desc, task_id) = 1"""


_set(
    i1_save=f"""with stored as ({FLAT_CATALOGUE}, page_id from ({TASKS})),
      incoming as (select * replace (generated_at + 10 as generated_at) from stored where url like 'https%'),
      fresh as (select * replace (md5({HOST}) as task_id) from stored
        qualify row_number() over (partition by {HOST} order by generated_at desc) = 1),
      kept as (select * from stored where url not like 'https%' union all select * from incoming union all select * from fresh)
      select * exclude (page_id) from kept""",
    i2_get=f"{FLAT_CATALOGUE} from ({TASKS}) where contains(url, '/en/')",
    i3_list=f"""select task_id, generated_at, cast(cast(generated_at as decimal(20, 6)) as varchar) as listed_as
      from ({FLAT_CATALOGUE} from ({TASKS}))""",
    i4_delete=f"{FLAT_CATALOGUE} from ({TASKS}) where not contains(url, '/en/')",
    i5_similar=_similar(REQUESTS, TASKS),
    i5_hot_host=_similar(HOT_REQUESTS, HOT_STORED),
    i6_resolve=f"""select task_id, url not like 'https%' as to_generate, case when url like 'https%' then 'h1' end as selector from ({TASKS})""",
    i9_loose_flags="""select p_partkey, p_name as selector, case p_partkey % 5 when 0 then true when 1 then true when 2 then false when 3 then false end as multiple
      from part""",
    i7_retry=f"select page_id, task_id from ({TASKS}) join pages using (page_id) where len(list_filter({HREFS}, lambda x: contains(x, 'n'))) = 0",
    i9_parse_response="""select p_partkey, cast(case when p_partkey % 4 < 2 then 1 else 0 end as bigint) as n,
      case when p_partkey % 4 < 2 then p_name end as selector, case when p_partkey % 4 < 2 then true end as multiple,
      case when p_partkey % 4 < 2 then 'n' else '' end as next_selector from part""",
    i10_stamp=f"""select task_id, generated_at, url, data_description, 'given' as provider, cast(null as boolean) as refined
      from ({FLAT_CATALOGUE} from ({TASKS}))""",
)

_shape = """{
  "selectors": [
    {
      "name": "<field>",
      "selector": "<CSS path>",
      "type": "<text, html, href, src or attribute>",
      "attribute": "<only for type attribute>",
      "multiple": <true for a list>,
      "post_processing": "<clean-up, if any>"
    }
  ],
  "pagination": {
    "selector": "<CSS path of the next-page element>",
    "type": "<link, button or parameter>"
  }
}"""
_set(
    i8_prompts=f"""select task_id, 'Write CSS selectors for the page ' || url || ' that extract: ' || data_description || '
Name every field, give its selector, its type and any clean-up it needs.
Answer with JSON alone, in this shape:
{_shape}' as prompt from ({TASKS})
      union all select task_id, 'Improve the CSS selectors used on the page ' || url || ' to extract: ' || data_description || '
Current selectors:
[{{"name":"title","selector":"h1","type":"text","attribute":"","multiple":false,"post_processing":""}}]
Current pagination:
' || case when page_id % 3 <> 0 then '{{"selector":"nav a","type":"link"}}' else '{{}}' end || '
What went wrong:
' || feedback || '
Answer with JSON alone, in this shape:
{_shape}' from ({_rated}) where rating < 5""",
)

# -- J ------------------------------------------------------------------------------
_set(
    j1_csv=f"""select cast(id as varchar) as id, name, price, rating, link, description,
      '["' || name || '","' || rating || '"]' as tags from ({ITEMS})""",
    j2_json="select doc_id, text, lang from documents",
    j3_dispatch="select cast(p_partkey as varchar) as p_partkey, p_name from part union all select cast(p_partkey as varchar), p_name from part",
    j4_formats="""select cast(c_custkey as varchar) as c_custkey, c_name, 'csv' as format from customer
      union all select cast(c_custkey as varchar), c_name, 'json' from customer""",
    j5_chunks="""select chunk, cast(ceil((select count(*) from orders) / 1000.0) as bigint) as chunks, count(*) as n,
      min(o_orderkey) as first, max(o_orderkey) as last, cast(1 as bigint) as files
      from (select o_orderkey, (row_number() over (order by o_orderkey) - 1) // 1000 as chunk from orders) group by 1""",
    j6_empty=f"""select 'header' as kind, unnest(['description', 'id', 'link', 'name', 'price', 'rating']) as name, cast(null as bigint) as n
      union all select 'csv', null, count(*) from ({ITEMS}) where name = 'no such name'
      union all select 'json', null, count(*) from ({ITEMS}) where name = 'no such name'""",
    j7_json_write=f"{FLAT_CATALOGUE} from ({TASKS})",
)

# -- whole jobs ------------------------------------------------------------------------
def _as_text(x: str) -> str:
    return clean(no_tags(basic_entities(collapse(f"trim({unescape(x)})"))))


_set(
    scrape_by_domain=f"""select {HOST} as domain, count(*) as records, count(nullif({clean(f"trim({unescape(H1)})")}, '')) as headlines,
      count(nullif({_as_text(AD)}, '')) as ads, cast(sum(length(nullif({clean(f"trim({unescape(H1)})")}, ''))) as bigint) as headline_chars
      from pages group by 1""",
    scrape_tasks=f"""select task_id, page_id, trim({unescape("data_description")}) as title from ({TASKS})""",
    task_run=f"""with t as (select *, nullif({clean(f"trim({unescape('data_description')})")}, '') as title from ({TASKS})),
      found as (select a.task_id, b.page_id - a.page_id + 1 as page_no, b.title from t a join t b on b.page_id in (a.page_id, a.page_id + 1)
        where a.page_id % 3 <> 0 or a.page_id % 6 = 0)
      select * from found where title is not null
      union all select task_id, null, 'Improve the' from t where page_id % 3 = 0 and page_id % 6 <> 0""",
    record_chain=f"""with typed as (select {_typed} from ({ITEMS})),
      done as (select id, nullif({clean("name")}, '') as title, price, rating, nullif({clean("link")}, '') as url from typed),
      firsts as (select * from done qualify row_number() over (partition by title, price order by id) = 1)
      select id, title, price, rating, url from firsts where price >= 900 and regexp_matches(title, '^[a-m]')""",
    lineitem_first_per_part="select l_partkey, min(l_orderkey * 1000 + l_linenumber) as _ord from lineitem group by 1",
)

# -- tables that change, records without a schema, SQL --------------------------------------
_set(
    i1_snapshot_versions=f"""with stored as ({FLAT_CATALOGUE} from ({TASKS})),
      second as (select * replace (case when url like 'https%' then generated_at + 10 else generated_at end as generated_at) from stored)
      select *, 'second' as version from second union all select *, 'last' from second where not contains(url, '/en/')""",
    a4_ragged_records="""select cast(p_partkey as bigint) as id, cast(case when p_partkey % 3 = 0 then p_size end as bigint) as size,
      case when p_partkey % 2 = 0 then cast(p_size as varchar) else p_brand end as code, case when p_partkey % 5 = 0 then p_type end as kind,
      array_to_string(list_filter([case when p_partkey % 5 <> 0 then 'more' end, case when p_partkey % 3 = 2 then 'size' end], lambda x: x is not null), ',') as absent
      from part""",
    d7_merge_maps="""select p_partkey, p_name as name, case when p_partkey % 2 = 0 then 'new' else p_brand end as brand, p_type as kind,
      case when p_partkey % 2 = 0 then 'x' end as extra, cast(p_retailprice as double) as a,
      case when p_partkey % 2 = 0 then 1.0::double else cast(p_retailprice as double) end as b from part""",
    j4_formats_agree=f"select id, true as same from ({ITEMS})",
    b1_sql_function=f"select page_id, trim({unescape(H1)}) as title, len({HREFS}) as links from pages",
    b8_rules_per_task="""select p.page_id as task, n as page_no, p.page_id + n - 1 as page_id
      from pages p, range(1, 10) r(n) where n <= p.page_id % 10 and exists (select 1 from pages q where q.page_id = p.page_id + n - 1)""",
)

_set(
    b1_wider_grammar=f"""select page_id, array_to_string(list_filter({HREFS}, lambda x, i: i % 2 = 1), '|') as odd,
      array_to_string({HREFS}[2:], '|') as later, {HREFS}[-1] as last, trim({unescape(H1)}) as title, 'utf-8' as charset, cast(null as varchar) as none from pages""",
)
