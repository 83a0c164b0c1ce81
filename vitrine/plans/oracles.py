"""The registered queries in DuckDB SQL, written plainly: nested loops and windows, no indexes."""

from __future__ import annotations

from vitrine.functions import values as V
from vitrine.plans.views import AS_OF, EMPTY_CATEGORY

MONEY = "cast(round(cast({p} as decimal(12,2)) * (100 - cast({d} as decimal(5,2))) * cast(0.01 as decimal(3,2)), 2) as decimal(12,2))"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _digits(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"


def _fold(c: str) -> str:
    return f"strip_accents(lower({c}))"


def _tokens(c: str) -> str:
    return f"regexp_extract_all({_fold(c)}, '[\\p{{L}}\\p{{N}}]+')"


def _words(c: str, n: int) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({_fold(c)}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= {n}))"


def _terms(c: str) -> str:
    return _tokens(c)


def _pairs(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c}) + 2), lambda i: substr('_' || {c} || '_', i, 2)))"


CODE = "translate(lpad(cast(c_custkey as varchar), 9, '0'), '0123456789', 'aeioubcdfg')"
PHONE = (
    "'(67) 9' || lpad(cast((c_custkey // 10000) % 10000 as varchar), 4, '0') || '-'"
    " || lpad(cast(c_custkey % 10000 as varchar), 4, '0')"
)
EMAIL = "lower(replace(c_name, '#', '.')) || '@example.com'"
TRACK = "'BRAB' || lpad(cast(o_orderkey as varchar), 7, '0') || 'BR'"
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _trim(c: str) -> str:
    return f"trim({c}, {SPACES})"


VIEWS = {
    "v_category": f"""
select cast(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) as int) category_id,
       case p_type when 'ECONOMY' then 'Econômico' when 'PROMO' then 'Promoção' else p_type end as name
from (select distinct p_type from part)
union all select {EMPTY_CATEGORY[0]}, '{EMPTY_CATEGORY[1]}'""",
    "v_product": """
select p_partkey product_id, p_name as name,
       cast(list_position(['ECONOMY','LARGE','MEDIUM','PROMO','SMALL','STANDARD'], p_type) as int) category_id,
       cast(p_retailprice as decimal(12,2)) price_brl,
       p_brand || case p_size % 3 when 0 then ' violão' when 1 then ' percussão' else ' clássico' end description,
       greatest(p_size - 5, 0) stock_quantity,
       case p_partkey % 20 when 0 then 'discontinued' when 1 then 'coming_soon' else 'active' end status,
       case when p_partkey % 10 = 0 then 'size ' || p_size
            else '{"brand":"' || p_brand || '","size":"' || p_size || '"}' end specs_raw,
       date '2020-01-01' + cast(p_partkey % 1000 as int) created_at
from part""",
    "v_promo": """
select l_orderkey * 8 + l_linenumber promotion_id, l_partkey product_id,
       cast(round(l_discount * 100) as decimal(5,2)) discount_percent,
       l_returnflag || '-' || l_linenumber description, l_linestatus = 'O' is_active
from lineitem""",
    "v_best": """
select product_id, discount_percent, description promo_name, promotion_id from (
  select *, row_number() over (partition by product_id
         order by discount_percent desc, description, promotion_id) rn from v_promo where is_active) where rn = 1""",
    "v_catalogue": f"""
select p.*, c.name category,
       case when coalesce(b.discount_percent, 0) <> 0 then b.promo_name end promo_name,
       case when coalesce(b.discount_percent, 0) <> 0 then b.discount_percent end discount_percent,
       case when coalesce(b.discount_percent, 0) <> 0
            then {MONEY.format(p='p.price_brl', d='b.discount_percent')} end promo_price_brl
from v_product p join v_category c using (category_id) left join v_best b using (product_id)""",
    "v_active_promo": f"""
select r.promotion_id, r.product_id, p.name product, r.description promo_name, p.price_brl original_price_brl,
       r.discount_percent, {MONEY.format(p='p.price_brl', d='r.discount_percent')} promo_price_brl
from v_promo r join v_product p using (product_id) where r.is_active""",
    "v_customer": f"""
select c_custkey customer_id, 'Cliente ' || {CODE} as name, {PHONE} phone, {EMAIL} email, n_name city
from customer join nation on c_nationkey = n_nationkey""",
    "v_order": f"""
select o_orderkey order_id, o_custkey customer_id, cast(o_orderdate as date) order_date,
       case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'pending' end status,
       cast(o_totalprice as decimal(12,2)) total_brl,
       case when o_orderkey % 11 = 0 then null when o_orderkey % 11 = 1 then 'voucher'
            else case left(o_orderpriority, 1) when '1' then 'pix' when '2' then 'debit' when '3' then 'boleto'
                 when '4' then 'credit_6x' else 'credit_12x' end end payment_method,
       case when o_orderstatus in ('F', 'O') then {TRACK} end tracking_code,
       cast((select max(l_shipdate) from lineitem where l_orderkey = o_orderkey) as date) estimated_delivery,
       case when o_orderkey % 5 = 0 then 'entregar à tarde' end notes
from orders""",
    "v_label": f"""
select *, case when coalesce(payment_method, '') = '' then '{V.NO_PAYMENT}'
   when payment_method = 'pix' then 'PIX' when payment_method = 'debit' then 'Cartão de Débito'
   when payment_method = 'boleto' then 'Boleto Bancário'
   when regexp_matches(payment_method, '^credit_[0-9]+x')
     then 'Cartão de Crédito ' || regexp_extract(payment_method, '^credit_([0-9]+)x', 1) || 'x'
   else payment_method end label,
   coalesce(estimated_delivery, order_date) ref, date '{AS_OF}' as_of
from v_order""",
    "v_due": f"""
select *, case when status = 'delivered' and ref is not null then 1 end has_due,
   case when status <> 'delivered' then {_q(V.NOTE_NOT_DELIVERED)}
        when ref is null then {_q(V.NOTE_NO_DATE)} end deadlines_note,
   '{V.REFERENCE_TEXT}' || strftime(ref, '%d/%m/%Y') referencia,
   strftime(ref + 7, '%d/%m/%Y') arrependimento_7d_ate, as_of > ref + 7 arrependimento_7d_expirado,
   strftime(ref + 30, '%d/%m/%Y') troca_defeito_30d_ate, as_of > ref + 30 troca_defeito_30d_expirado,
   case when as_of > ref + 30 then {_q(V.PATH_EXPIRED)} when as_of > ref + 7 then {_q(V.PATH_DEFECT)}
        else {_q(V.PATH_OPEN)} end caminho_sugerido,
   strftime(as_of, '%d/%m/%Y') hoje,
   case when estimated_delivery is not null then 'estimated_delivery' else 'order_date' end ref_source
from v_label""",
    "v_item": "select l_orderkey order_id, l_partkey product_id, cast(l_quantity as int) quantity from lineitem",
    "v_numbered_item": """
select *, row_number() over (partition by order_id order by quantity, name, price_brl, product_id) line
from (select case when l_linenumber = 1 then 0 else l_orderkey end order_id, product_id, name, cast(l_quantity as bigint) quantity,
        cast(price_brl as double) price_brl from lineitem join v_product on product_id = l_partkey)""",
    "v_message": "select 's' || conv_id session_id, turn message_id, role, text as content from conversations",
    "v_long": """
select 's' || (conv_id // 8) session_id, conv_id % 8 * 1000 + turn message_id, role, text as content from conversations""",
    "v_search": f"""
select p_partkey * 2 request_id,
  case p_partkey % 8 when 0 then p_name when 1 then p_brand when 2 then '  ' || upper(p_name) || '!'
   when 3 then 'violao ' || split_part(p_name, ' ', 1) when 4 then translate(p_name, 'aeiou', 'eioua')
   when 5 then null when 6 then left(p_name, 4) || ' zz yy xx ww vv uu tt ' || p_brand
   else 'percussao_' || split_part(p_name, ' ', 2) end query,
  case when p_size % 6 = 0 then left(lower(p_type), 5) end category,
  case when p_size % 3 = 0 then cast(p_retailprice + 5 as decimal(12,2)) end max_price,
  case when p_size % 4 = 0 then cast(p_retailprice - 10 as decimal(12,2)) end min_price,
  p_size % 2 = 0 in_stock_only, p_size % 5 = 0 include_discontinued,
  case when p_size % 7 > 0 then p_size % 7 else 6 end lim
from part
union all
select (conv_id * 1000 + turn) * 2 + 1, text, null, null, null, false, false, 6 from conversations where role = 'user'""",
    "v_token": f"""
select distinct product_id, unnest({_tokens("name || ' ' || description || ' ' || category")}) token from v_catalogue""",
    "v_term": f"""
select request_id, pos - 1 pos, term from (
  select request_id, unnest(t) term, generate_subscripts(t, 1) pos from (
    select request_id, list_filter(a, lambda x, i: list_position(a, x) = i) t
    from (select request_id, {_terms('query')} a from v_search where query is not null)))""",
    "v_pair": """
select distinct t.request_id, k.product_id from v_term t
join (select term, token from (select distinct term from v_term), (select distinct token from v_token)
      where starts_with(token, term)) m using (term)
join v_token k using (token)
union all
select s.request_id, c.product_id from (select request_id from v_search except select request_id from v_term) s, v_product c""",
    "v_hit": f"""
select request_id, rank, product_id from (
  select s.request_id, s.lim, c.product_id,
         row_number() over (partition by s.request_id order by c.price_brl, c.product_id) as rank
  from v_pair join v_search s using (request_id) join v_catalogue c using (product_id)
  where (s.include_discontinued or c.status in ('active', 'coming_soon'))
    and (not s.in_stock_only or c.stock_quantity > 0)
    and (s.max_price is null or c.price_brl <= s.max_price) and (s.min_price is null or c.price_brl >= s.min_price)
    and (s.category is null or contains({_fold('c.category')}, {_fold('s.category')})))
where rank <= lim""",
    "v_detail": f"""
select *, n_hits = 1 or (covers and n_covering = 1) as "full", len(qwords) > 0 and n_covering = 0 as partial from (
  select *, count(*) over (partition by request_id) n_hits,
         count(*) filter (covers) over (partition by request_id) n_covering from (
    select h.request_id, h.rank, c.*, {_words("coalesce(s.query, '')", 2)} qwords,
           len({_words("coalesce(s.query, '')", 2)}) > 0
           and list_has_all({_words('c.name', 2)}, {_words("coalesce(s.query, '')", 2)}) covers
    from v_hit h join v_search s using (request_id) join v_catalogue c using (product_id)))""",
    "v_missed": f"""
select s.request_id, lower({_trim('s.query')}) q from v_search s
where {_trim("coalesce(s.query, '')")} <> '' and request_id not in (select request_id from v_hit)""",
    "v_lookup": f"""
select c_custkey request_id,
  case c_custkey % 6 when 0 then {PHONE} when 3 then right({PHONE}, 9) when 4 then '00000-0000-0000'
       when 5 then '(99) 1234' end phone,
  case when c_custkey % 6 in (1, 4) then upper({EMAIL}) when c_custkey % 6 = 5 then 'nobody@example.com' end email,
  case c_custkey % 6 when 2 then upper('cliente ' || {CODE}) when 5 then {CODE} when 0 then 'cliente' end as name
from customer""",
    "v_line": f"""
select doc_id, row_number() over (partition by doc_id order by p, h desc) - 1 pos, line from (
  select doc_id, p, h, {_trim('line')} line from (
    select doc_id, p, 0 h, line from (
      select doc_id, unnest(string_split(text, chr(10))) line, unnest(range(0, len(string_split(text, chr(10))))) p from documents)
    union all
    select doc_id, p, 1 h,
       case when (p - 5) % 15 = 0 then cast((p - 5) // 15 + 1 as varchar)
            else ((p - 5) // 15 + 1) || '.' || (((p - 5) % 15) // 5) end
       || case when p % 2 = 0 then '. Parte ' else ' Seção ' end || lang
    from (select doc_id, lang, unnest(range(0, len(string_split(text, chr(10))))) p from documents)
    where p >= 5 and p % 5 = 0)
  where {_trim('line')} <> '' and not regexp_full_match({_trim('line')}, 'Página [0-9]+'))""",
    "v_heading": r"""
select *, regexp_matches(line, '^\p{Nd}+(\.\p{Nd}+)*\.?\s+\S') and length(title) <= 90
          and not regexp_matches(title, '[.,;:]$') is_heading from (
  select *, regexp_extract(line, '^(\p{Nd}+(?:\.\p{Nd}+)*)\.?\s+(\S.*)$', 1) num,
            regexp_extract(line, '^(\p{Nd}+(?:\.\p{Nd}+)*)\.?\s+(\S.*)$', 2) title from v_line)""",
    "v_cut": f"""
select doc_id, sec, coalesce(max(case when is_heading then num || '. ' || trim(title) end), '{V.COVER_SECTION}') section,
   replace(trim(regexp_replace(coalesce(string_agg(case when not is_heading then line end, ' ' order by pos), ''),
           '\\s+', ' ', 'g')), '—', '-') body
from (select *, sum(cast(is_heading as int)) over (partition by doc_id order by pos) sec from v_heading)
group by doc_id, sec""",
    "v_section": """
select doc_id, row_number() over (partition by doc_id order by sec) - 1 section_no, section, body
from v_cut where body <> ''""",
    "v_sentence": r"""
select doc_id, section_no, section, i, s, length(s) n from (
  select doc_id, section_no, section, unnest(a) s, generate_subscripts(a, 1) i from (
    select *, case when length(body) <= 1200 then [body]
              else string_split(regexp_replace(body, '([.;:])\s+', '\1' || chr(1), 'g'), chr(1)) end a from v_section))""",
    "v_pack": """
select doc_id, section_no, section, i, s, n, 1 piece, n used from v_sentence where i = 1
union all
select x.doc_id, x.section_no, x.section, x.i, x.s, x.n,
       case when p.used + x.n + 1 > 1200 then p.piece + 1 else p.piece end,
       case when p.used + x.n + 1 > 1200 then x.n else p.used + x.n + 1 end
from v_pack p join v_sentence x on x.doc_id = p.doc_id and x.section_no = p.section_no and x.i = p.i + 1""",
    "v_chunk": """
select doc_id, row_number() over (partition by doc_id order by section_no, piece) chunk_no, section,
   '[Manual - ' || case when section = 'Capa' then 'capa' else section end || ']' || chr(10) || body as text
from (select doc_id, section_no, section, piece, string_agg(s, ' ' order by i) body from v_pack group by all)""",
    "v_ask": f"""
select distinct doc_id, case when regexp_full_match(k, '[\\p{{Nd}}.]+') then rtrim(k, '.') else k end as key from (
  select doc_id, {_fold(_trim("coalesce(section, '')"))} k from v_section_request)""",
    "v_section_request": """
select 'manual' as source, doc_id, case doc_id % 6 when 0 then '1' when 1 then ' 1.1. ' when 2 then upper(split_part(text, ' ', 2))
  when 3 then 'xpto' || doc_id when 4 then split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 4) end section from documents""",
    "v_numbered": r"""
select a.doc_id, a.key, s.section_no from v_ask a join (
   select *, regexp_extract(section, '^\p{Nd}+(\.\p{Nd}+)*') num from v_section) s using (doc_id)
where regexp_full_match(a.key, '[\p{Nd}.]+') and (s.num = a.key or starts_with(s.num, a.key || '.'))""",
    "v_keyed": f"""
select a.doc_id, a.key, s.section_no from v_ask a join v_section s using (doc_id)
where a.key <> '' and not regexp_full_match(a.key, '[\\p{{Nd}}.]+')
  and contains({_fold("s.section || ' ' || s.body")}, a.key)""",
    "v_picked": "select * from v_numbered union all select * from v_keyed",
    "v_retrieved": """
select p.doc_id, p.key, true as found, s.section_no, s.section, s.body from v_picked p join v_section s using (doc_id, section_no)
union all
select a.doc_id, a.key, a.key = '', s.section_no, s.section, case when a.key = '' then s.body end
from v_ask a join v_section s using (doc_id)
where a.key = '' or not exists (select 1 from v_picked p where p.doc_id = a.doc_id and p.key = a.key)""",
    "v_route_request": f"""
select c_custkey * 3 request_id,
   case c_custkey % 5 when 0 then {PHONE} when 1 then upper({EMAIL}) when 2 then {CODE} when 3 then ' cliente ' || {CODE}
        else {CODE} end query,
   case when c_custkey % 10 = 4 then 'clientes' when c_custkey % 10 = 9 then 'pedidos' else 'auto' end entity
from customer
union all
select o_orderkey * 3 + 1, case o_orderkey % 3 when 0 then cast(o_orderkey as varchar) when 1 then lower({TRACK})
        else '#' || o_orderkey end, case when o_orderkey % 2 = 0 then 'pedidos' else 'auto' end
from orders
union all
select p_partkey * 3 + 2, case p_partkey % 4 when 0 then p_name when 1 then p_name || ' ' || lower(p_type)
        when 2 then upper(p_name) || ' zzqx'
        else case when p_partkey % 8 = 7 then replace(p_name, ' ', 'x ') || 'x' else split_part(p_name, ' ', 1) end end,
   case p_partkey % 6 when 0 then 'produtos' when 1 then 'promocoes' else 'auto' end
from part""",
    "v_rule": f"""
select *, case when entity = 'produtos' then 'product' when entity = 'promocoes' then 'promotion'
   when entity = 'clientes' then 'customer'
   when entity = 'pedidos' then case when regexp_full_match(q, '[0-9]+') then 'order_id'
        when regexp_full_match(q, '[A-Za-z0-9]{{10,}}') then 'tracking' else 'customer' end
   when contains(q, '@') then 'email' when length({_digits('q')}) >= 8 then 'phone'
   when regexp_full_match(q, '[0-9]+') then 'order_id' when regexp_full_match(q, '[A-Za-z0-9]{{10,}}') then 'tracking'
   when length(q) >= 5 then 'maybe' else 'product' end rule
from (select request_id, {_trim('query')} q, entity from v_route_request)""",
    "v_found": f"""
select request_id, customer_id, way, case way when 1 then digits else lower(q) end as key from (
  select *, min(way) over (partition by request_id) best from (
    select r.request_id, c.customer_id, 1 way, r.q, {_digits('r.q')} digits from v_rule r join v_customer c
      on r.rule in ('customer', 'maybe', 'phone') and {_digits('r.q')} <> '' and contains({_digits('c.phone')}, {_digits('r.q')})
    union all
    select r.request_id, c.customer_id, 2, r.q, null from v_rule r join v_customer c
      on r.rule in ('customer', 'maybe', 'email') and contains(r.q, '@') and lower(r.q) = lower(c.email)
    union all
    select r.request_id, c.customer_id, 3, r.q, null from v_rule r join v_customer c
      on r.rule in ('customer', 'maybe') and r.q <> '' and contains(lower(c.name), lower(r.q))))
where way = best""",
    "v_routed": """
select request_id, q, entity, case when rule <> 'maybe' then rule
   when request_id in (select request_id from v_found) then 'customer' else 'product' end kind from v_rule""",
    "v_page_key": "select distinct left(lower(p_type), 5) as key from part where p_partkey % 4 = 0",
    "v_page": f"""
select * from (select k.key, c.*, row_number() over (partition by k.key order by c.price_brl, c.product_id) as rank
  from v_page_key k join v_catalogue c on contains({_fold('c.category')}, {_fold('k.key')})
  where c.status in ('active', 'coming_soon'))""",
    "v_reset": "select distinct 's' || user_id session_id from events where event_type = 'error' and user_id % 3 > 0",
    "v_failed": "select distinct 's' || user_id session_id from events where event_type = 'error'",
    "v_reply": """
select session_id, case when length(content) % 5 = 0 then ' ' else content end as content
from v_message where role = 'assistant'""",
}


def _sql(body: str, *views: str, **other: str) -> str:
    """A query over the named views; ``other`` replaces the definition of some."""
    return "with recursive " + ",\n".join(f"{v} as ({other.get(v, VIEWS[v])})" for v in views) + "\n" + body


CATALOGUE = ("v_category", "v_product", "v_promo", "v_best", "v_catalogue")
SEARCH = (*CATALOGUE, "v_search", "v_token", "v_term", "v_pair", "v_hit")
DOCS = ("v_line", "v_heading", "v_cut", "v_section")
CHUNKS = (*DOCS, "v_sentence", "v_pack", "v_chunk")
RETRIEVE = (*DOCS, "v_section_request", "v_ask", "v_numbered", "v_keyed", "v_picked", "v_retrieved")
DUE = ("v_order", "v_label", "v_due")
ROUTED = ("v_customer", "v_route_request", "v_rule", "v_found", "v_routed")

CHANGED_DOCUMENTS = (
    "select * replace (case when doc_id % 3 = 0 then 'Novo. ' || text else text end as text) from documents"
)
PROMO_COLUMNS = """promo_name, cast(discount_percent as double) discount_percent,
  cast(promo_price_brl as double) promo_price_brl"""
MASK = """name, city, case when length(phone) = 0 then phone else
  left(phone, 4) || repeat('*', greatest(length(phone) - 8, 0)) || right(phone, 4) end phone,
  case when contains(email, '@') then left(split_part(email, '@', 1), 2)
    || repeat('*', greatest(length(split_part(email, '@', 1)) - 2, 1)) || '@' || substr(email, instr(email, '@') + 1)
    else email end email"""
PROMO_JSON = """case when promo_price_brl is not null then {name: promo_name,
  discount_percent: cast(discount_percent as double), promo_price_brl: cast(promo_price_brl as double)} end"""
BRIEF = f"""product_id: product_id, name: name, category: category, price_brl: cast(price_brl as double),
  promo: {PROMO_JSON}, stock_quantity: stock_quantity, status: status"""
PRODUCT_JSON = f"""case when not "full" then cast(to_json({{{BRIEF}}}) as varchar)
  when starts_with(specs_raw, '{{') then cast(to_json({{{BRIEF}, description: description, specs: cast(specs_raw as json)}}) as varchar)
  else cast(to_json({{{BRIEF}, description: description, specs: specs_raw}}) as varchar) end"""
ORDER_JSON = """cast(to_json({order_id: o.order_id, customer_name: c.name, order_date: cast(o.order_date as varchar), status: o.status,
    total_brl: cast(o.total_brl as double), payment_method: o.label, tracking_code: o.tracking_code,
    estimated_delivery: cast(o.estimated_delivery as varchar),
    deadlines: case when has_due = 1 then {referencia: referencia, arrependimento_7d_ate: arrependimento_7d_ate,
      arrependimento_7d_expirado: arrependimento_7d_expirado, troca_defeito_30d_ate: troca_defeito_30d_ate, troca_defeito_30d_expirado: troca_defeito_30d_expirado,
      caminho_sugerido: caminho_sugerido, hoje: hoje, ref_source: ref_source} end,
    deadlines_note: o.deadlines_note, items: {list: o.order_id, count: coalesce(i.n, 0)}, notes: o.notes}) as varchar)"""
ORDERS_JSON = f"""
select o.order_id, o.customer_id, c.name customer_name, upper(o.tracking_code) code, o.order_date, {ORDER_JSON} payload
from v_due o join v_customer c using (customer_id) left join (
  select order_id, count(*) n from v_item join v_product using (product_id) group by order_id) i using (order_id)"""
NEWEST = "order_date desc nulls last, order_id"
CASCADE = f"""
select request_id, cast(way as bigint) way, customer_id from (
  select *, min(way) over (partition by request_id) best from (
    select r.request_id, 1 way, c.customer_id from v_lookup r join v_customer c
      on length({_digits('r.phone')}) >= 4 and contains({_digits('c.phone')}, {_digits('r.phone')})
    union all
    select r.request_id, 2, c.customer_id from v_lookup r join v_customer c on lower(r.email) = lower(c.email)
    union all
    select r.request_id, 3, c.customer_id from v_lookup r join v_customer c on contains(lower(c.name), lower(r.name))))
where way = best"""

VIEWS["v_similar"] = f"""
select * from (with asked as (select distinct q, unnest({_words('q', 1)}) w from v_missed),
known as (select distinct name, unnest({_words('name', 1)}) w from v_catalogue where status in ('active', 'coming_soon')),
asked_pair as (select w, p, len(ps) n from (select w, {_pairs('w')} ps from (select distinct w from asked)), unnest(ps) t(p)),
known_pair as (select w, p, len(ps) n from (select w, {_pairs('w')} ps from (select distinct w from known)), unnest(ps) t(p)),
alike as (select a, k, cast(2.0 as double) * shared / (an + kn) score from (
  select a.w a, k.w k, a.n an, k.n kn, count(*) shared from asked_pair a join known_pair k using (p) group by all)
  where cast(2.0 as double) * shared / (an + kn) >= 0.6),
scored as (select q, name, cast(max(score) as double) score from asked join alike on a = asked.w join known on k = known.w
  group by q, name),
page as (select * from scored qualify row_number() over (partition by q order by name) <= {V.SUGGESTIONS_SHOWN})
select request_id, suggestions, score from v_missed join (
  select q, array_to_string(list_sort(list(name)), ', ') suggestions, max(score) score from page group by q) using (q))"""
VIEWS["v_payload"] = ORDERS_JSON
# The same with the items of each order in its payload.
WHOLE_ORDERS_JSON = f"""
select o.order_id, o.customer_id, c.name customer_name, upper(o.tracking_code) code, o.order_date,
  {ORDER_JSON.replace("{list: o.order_id, count: coalesce(i.n, 0)}", "coalesce(i.items, [])")} payload
from v_due o join v_customer c using (customer_id) left join (
  select order_id, list({{quantity: quantity, name: name, price_brl: cast(price_brl as double)}}
                        order by quantity, name, price_brl) items
  from v_item join v_product using (product_id) group by order_id) i using (order_id)"""
# The promotions of a request: its lists by name and size.
PROMOTIONS_NAMED = f"""select t.request_id, 'promocoes', 0, cast(to_json({{list: t.term, count: n.n}}) as varchar)
from (select request_id, unnest(case when len(w) > 0 then w else ['*'] end) term from (
        select request_id, {_words('q', 4)} w from v_routed where kind = 'promotion' or (kind = 'product' and q <> ''))) t
join (select term, sum(n) n from (
        select term, product from (select distinct unnest({_words('q', 4)}) term from v_routed where kind in ('promotion', 'product')),
          (select distinct product from v_active_promo) where contains({_fold('product')}, term)
        union all select '*', product from (select distinct product from v_active_promo))
      join (select product, count(*)::bigint n from v_active_promo group by product) using (product) group by term) n using (term)"""
# The same with a row for each promotion of the request, by its place among all.
PROMOTIONS_WRITTEN = f"""select r.request_id, 'promocoes', p.seq, cast(to_json({{product: product, promo_name: promo_name,
  original_price_brl: cast(original_price_brl as double), discount_percent: cast(discount_percent as double),
  promo_price_brl: cast(promo_price_brl as double)}}) as varchar)
from (select request_id, {_words('q', 4)} w from v_routed where kind = 'promotion' or (kind = 'product' and q <> '')) r
join (select w, name from (select distinct {_words('q', 4)} w from v_routed where kind in ('promotion', 'product')),
        (select distinct product as name from v_active_promo)
      where len(w) = 0 or len(list_filter(w, lambda t: contains({_fold('name')}, t))) > 0) m using (w)
join (select *, row_number() over (order by discount_percent desc, promotion_id, product_id, promo_name) seq
      from v_active_promo) p on p.product is not distinct from m.name"""
# Answers to the routed requests: (request_id, part, seq, payload).
VIEWS["v_answer"] = f"""
select request_id, 'produtos' part, rank seq, {PRODUCT_JSON} payload from v_detail
union all select distinct request_id, 'aviso', 0, {_q(V.ADVICE_PARTIAL)} from v_detail where partial
union all select request_id, 'aviso', 0, {_q(V.ADVICE_SIMILAR)} || suggestions || {_q(V.ADVICE_SIMILAR_END)} from v_similar
union all
{PROMOTIONS_NAMED}
union all
select request_id, 'clientes', customer_id, cast(to_json({{customer_id: customer_id, name: name, city: city, phone: phone, email: email}}) as varchar)
from (select request_id, customer_id, {MASK} from v_found join v_routed using (request_id) join v_customer using (customer_id)
      where kind in ('email', 'phone', 'customer'))
union all
select r.request_id, 'pedidos', row_number() over (partition by r.request_id order by {NEWEST}), p.payload from v_routed r join v_payload p
  on (r.kind = 'order_id' and r.q = cast(p.order_id as varchar)) or (r.kind = 'tracking' and upper(r.q) = p.code)
union all
select request_id, 'pedidos', row_number() over (partition by request_id order by customer_id, {NEWEST}), p.payload from v_found join v_routed using (request_id)
  join v_payload p using (customer_id) where kind in ('email', 'phone', 'customer')"""
VIEWS["v_answered"] = f"""
select * from v_answer
union all
select request_id, 'aviso', 0, {_q(V.ADVICE_NOTHING)} from v_routed
where kind in ('email', 'phone', 'customer', 'product') and request_id not in (select request_id from v_answer)"""
WHOLE_ANSWER = VIEWS["v_answer"].replace(PROMOTIONS_NAMED, PROMOTIONS_WRITTEN)
ROUTED_SEARCH = """
select request_id, q query, null::varchar category, null::decimal(12,2) max_price, null::decimal(12,2) min_price,
  false in_stock_only, false include_discontinued, 6 lim from v_routed where kind = 'product'"""
WHOLE_REQUESTS = VIEWS["v_route_request"] + """
union all
select -1 - p_partkey, split_part(p_name, ' ', 1),
   case p_partkey % 6 when 0 then 'produtos' when 1 then 'promocoes' else 'auto' end
from part where p_partkey % 8 = 7"""
ANSWER = (
    *CATALOGUE, "v_active_promo", *ROUTED, *SEARCH[5:], "v_detail", "v_missed", "v_similar", *DUE, "v_item", "v_payload", "v_answer", "v_answered",
)
VIEWS["v_list"] = """
select distinct way, key, customer_id from v_found join v_routed using (request_id)
where kind in ('email', 'phone', 'customer')"""
CALL_CODE = "translate(lpad(cast(user_id as varchar), 9, '0'), '0123456789', 'aeioubcdfg')"
VIEWS["v_call"] = f"""
select event_id call_id, user_id doc_id, event_id % 2 = 0 as even, event_id % 4 = 1 as broken, event_type,
  json_extract_string(props, '$.k') k, user_id,
  case when event_type = 'view' then cast(user_id as varchar) else case event_id % 6 when 0 then 'hot bolt' when 1 then 'hotx boltx'
    when 2 then {CALL_CODE} when 3 then 'anvil' when 4 then 'ring' else 'zzzzz' || {CALL_CODE} end end query,
  case when event_type = 'view' then 'pedidos' else case event_id % 6 when 3 then 'promocoes' when 4 then 'produtos' else 'auto' end end entity,
  case when event_type = 'purchase' then cast(value as decimal(12,2)) + 900 end max_price,
  case when event_type = 'purchase' then 2 else 6 end lim
from events"""
CALLED = "select call_id request_id, query, entity from v_call where event_type in ('view', 'purchase')"
CALLED_SEARCH = """
select r.request_id, r.q query, null::varchar category, c.max_price, null::decimal(12,2) min_price,
  false in_stock_only, false include_discontinued, c.lim
from v_routed r join v_call c on c.call_id = r.request_id where r.kind = 'product'"""

ORACLES: dict[str, str] = {
    "catalogue_effective_price": _sql(
        f"""select category, product_id, name, cast(price_brl as double) price_brl, {PROMO_COLUMNS},
  cast(coalesce(promo_price_brl, price_brl) as double) effective_price, cast(stock_quantity as bigint) stock_quantity, status
from v_catalogue where status in ('active', 'coming_soon')""",
        *CATALOGUE,
    ),
    "best_promo": _sql(
        "select product_id, cast(discount_percent as double) discount_percent, promo_name, promotion_id from v_best",
        "v_promo", "v_best",
    ),
    "active_promotions": _sql(
        """select promotion_id, product_id, product, promo_name, cast(original_price_brl as double) original_price_brl,
  cast(discount_percent as double) discount_percent, cast(promo_price_brl as double) promo_price_brl,
  row_number() over (order by discount_percent desc, promotion_id, product_id, promo_name) seq from v_active_promo""",
        "v_product", "v_promo", "v_active_promo",
    ),
    "category_counts": _sql(
        """select *, row_number() over (order by name, category_id) seq from (
  select cast(c.category_id as bigint) category_id, c.name, 'linha ' || c.name description, count(p.product_id) product_count
  from v_category c left join v_product p on p.category_id = c.category_id and p.status = 'active' group by all)""",
        "v_category", "v_product",
    ),
    "catalogue_index": _sql(
        f"""select product_id, name, category, cast(price_brl as double) price_brl, {PROMO_COLUMNS} from (
  select * from v_catalogue where status in ('active', 'coming_soon'))""",
        *CATALOGUE,
    ),
    "search_price_band": _sql(
        """select product_id, name, cast(price_brl as double) price_brl, cast(stock_quantity as bigint) stock_quantity,
  cast(coalesce(promo_price_brl, price_brl) as double) effective_price
from v_catalogue where status in ('active', 'coming_soon') and price_brl between 905.5 and 950 and stock_quantity > 0
order by price_brl, product_id limit 50""",
        *CATALOGUE,
    ),
    "search_by_category": _sql(
        f"""select product_id, name, category, cast(price_brl as double) price_brl, matched, matched returned from (
  select *, count(*) over () matched from v_catalogue
  where status in ('active', 'coming_soon') and contains({_fold('category')}, 'econom'))""",
        *CATALOGUE,
    ),
    "text_fold": f"select doc_id, {_fold('text')} folded from documents",
    "query_terms": _sql("select request_id, pos, term from v_term", "v_search", "v_term"),
    "search_index_stats": _sql(
        "select token, count(*) n_products from v_token group by token", *CATALOGUE, "v_token"
    ),
    "search_batch": _sql(
        f"""select request_id, rank, product_id, name, category, cast(price_brl as double) price_brl, {PROMO_COLUMNS},
  cast(stock_quantity as bigint) stock_quantity, status from v_hit join v_catalogue using (product_id)""",
        *SEARCH,
    ),
    "search_stem_widened": _sql(
        "select request_id, rank, product_id from v_hit",
        *SEARCH,
        v_term=f"""
select distinct request_id, unnest(case when length(w) > 6 then [w, left(w, 6)] else [w] end) term
from (select request_id, unnest({_terms('query')}) w from v_search)""",
    ),
    "search_detail_level": _sql(
        """select request_id, product_id, rank, covers, n_hits, n_covering, "full", partial,
  case when "full" then description end description, case when "full" then specs_raw end specs from v_detail""",
        *SEARCH, "v_detail",
    ),
    "search_no_hit_advice": _sql(
        f"""select request_id, {_q(V.ADVICE_NOTHING)} advice from v_missed
union all select distinct request_id, {_q(V.ADVICE_PARTIAL)} from v_detail where partial""",
        *SEARCH, "v_detail", "v_missed",
    ),
    "promos_by_keyword": _sql(
        f"""select t.term, t.requests, p.promotion_id, p.product, p.promo_name,
  cast(p.original_price_brl as double) original_price_brl, cast(p.discount_percent as double) discount_percent,
  cast(p.promo_price_brl as double) promo_price_brl
from (select term, count(*) requests from (
        select unnest(case when len(w) > 0 then w else ['*'] end) term from (
          select {_words("coalesce(query, '')", 4)} w from v_search)) group by term) t
join (select term, product from (select distinct unnest({_words("coalesce(query, '')", 4)}) term from v_search),
        (select distinct product from v_active_promo) where contains({_fold('product')}, term)
      union all select '*', product from (select distinct product from v_active_promo)) m using (term)
join v_active_promo p using (product)""",
        "v_product", "v_promo", "v_active_promo", "v_search",
    ),
    "suggest_names": _sql("select * from v_similar", *SEARCH, "v_missed", "v_similar"),
    "suggest_names_lev": _sql(
        f"""select request_id, array_to_string(list_sort(list(name))[1:5], ', ') suggestions from (
  select m.request_id, n.name from v_missed m, (
    select distinct name from (select * from v_catalogue where status in ('active', 'coming_soon')
      order by price_brl, product_id limit {V.SUGGESTION_PAGE})) n
  where 1 - levenshtein(m.q, lower(n.name)) / greatest(length(m.q), length(n.name)) > 0.4) group by request_id""",
        *SEARCH, "v_missed",
    ),
    "product_first_match": _sql(
        """select request_id, product_id from (
  select request_id, product_id, row_number() over (partition by request_id order by way, product_id) rn from (
    select s.request_id, 1 way, p.product_id from v_search s join v_product p
      on s.request_id % 3 = 0 and p.product_id = s.request_id
    union all select request_id, 2, product_id from v_pair where request_id in (select request_id from v_term))) where rn = 1""",
        *SEARCH[:-1],
    ),
    "customers_masked": _sql(f"select customer_id, {MASK} from v_customer", "v_customer"),
    "customers_masked_whole": _sql(
        f"""select customer_id, name, city, case when length(phone) between 1 and 8 then repeat('*', length(phone)) else masked end phone, email
from (select customer_id, phone, {MASK.replace("end phone", "end masked", 1)} from (
  select * replace (case when customer_id % 4 = 0 then right(phone, 8) else phone end as phone) from v_customer))""",
        "v_customer",
    ),
    "customer_lookup_cascade": _sql(CASCADE, "v_customer", "v_lookup"),
    "customer_orders": _sql(
        f"""select request_id, customer_id, {MASK}, order_id, cast(order_date as varchar) order_date, status,
  cast(total_brl as double) total_brl from ({CASCADE}) join v_customer using (customer_id) left join v_order using (customer_id)""",
        "v_customer", "v_lookup", "v_order",
    ),
    "payment_labels": _sql("select order_id, payment_method, label from v_label", "v_order", "v_label"),
    "order_deadlines": _sql(
        "select order_id, status, "
        + ", ".join(
            f"case when has_due = 1 then {c} end {c}"
            for c in (
                "referencia", "arrependimento_7d_ate", "arrependimento_7d_expirado", "troca_defeito_30d_ate", "troca_defeito_30d_expirado",
                "caminho_sugerido", "hoje", "ref_source",
            )
        )
        + ", deadlines_note from v_due",
        *DUE,
    ),
    "order_lookup_batch": _sql(
        f"""select r.request_id, r.key, row_number() over (partition by r.request_id order by {NEWEST.replace("order_", "o.order_")}) seq, o.order_id, c.name customer_name, cast(o.order_date as varchar) order_date, o.status,
  cast(o.total_brl as double) total_brl, o.label payment_label, o.tracking_code,
  case when has_due = 1 then caminho_sugerido end caminho_sugerido, o.deadlines_note
from (select *, case when order_id is not null then 'order_id' when coalesce(tracking_code, '') <> '' then 'tracking_code'
         when customer_id is not null then 'customer_id' end as key from (
      select o_orderkey request_id, case o_orderkey % 5 when 0 then o_orderkey when 3 then -1 - o_orderkey end order_id,
         case when o_orderkey % 5 in (0, 1) then ' ' || lower({TRACK}) || ' ' end tracking_code,
         case when o_orderkey % 5 in (1, 2) then o_custkey end customer_id from orders)) r
join v_due o on case r.key when 'order_id' then r.order_id = o.order_id
   when 'tracking_code' then upper(trim(r.tracking_code)) = upper(o.tracking_code) else r.customer_id = o.customer_id end
join v_customer c on c.customer_id = o.customer_id""",
        *DUE, "v_customer",
    ),
    "orders_with_items": _sql(
        """select o.order_id, o.customer_id, i.product_id, i.name product, cast(i.quantity as bigint) quantity,
  cast(i.price_brl as double) price_brl
from v_order o left join (select * from v_item join v_product using (product_id)) i using (order_id)""",
        "v_order", "v_item", "v_product",
    ),
    "order_payload_json": _sql(
        "select order_id, customer_name, 0::bigint page, 1::bigint pages, payload from v_payload",
        *DUE, "v_customer", "v_item", "v_product", "v_payload", v_payload=WHOLE_ORDERS_JSON,
    ),
    "order_item_lines": _sql(
        """select order_id, line, product_id, name, quantity, price_brl,
  cast(to_json({quantity: quantity, name: name, price_brl: price_brl}) as varchar) payload from v_numbered_item""",
        "v_product", "v_numbered_item",
    ),
    "order_item_blocks": _sql(
        """select order_id, (line - 1) // 1000 block, count(*) n,
  cast(to_json(list({quantity: quantity, name: name, price_brl: price_brl} order by line)) as varchar) items
from v_numbered_item group by all""",
        "v_product", "v_numbered_item",
    ),
    "doc_lines": _sql("select doc_id, pos, line, is_heading from v_heading", "v_line", "v_heading"),
    "doc_sections": _sql("select doc_id, section_no, section, body from v_section", *DOCS),
    "doc_chunks": _sql("select doc_id, chunk_no, section, text from v_chunk", *CHUNKS),
    "sections_rejoined": _sql(
        r"""select doc_id, min(chunk_no) first_chunk, section,
  string_agg(regexp_replace(text, '^\[[^\]]*\]\n?', ''), chr(10) order by chunk_no) as text
from (select *, sum(fresh) over (partition by doc_id order by chunk_no) run from (
  select *, case when lag(section) over (partition by doc_id order by chunk_no) = section then 0 else 1 end fresh from v_chunk))
group by doc_id, run, section""",
        *CHUNKS,
    ),
    "sections_by_number": _sql("select * from v_numbered", *RETRIEVE[:7]),
    "sections_by_keyword": _sql("select * from v_keyed", *RETRIEVE[:6], "v_keyed"),
    "sections_miss_fallback": _sql("select * from v_retrieved", *RETRIEVE),
    "history_last_n": _sql(
        """select *, row_number() over (partition by session_id order by message_id) turn_no from (
  select * exclude (b) from (select *, row_number() over (partition by session_id order by message_id desc) b from v_message)
  where b <= 3)""",
        "v_message",
    ),
    "sessions_upsert": _sql(
        """select session_id, min(message_id) first_message_id from v_message
where session_id not in (select session_id from v_failed) group by session_id""",
        "v_message", "v_failed",
    ),
    "session_reset": _sql(
        "select * from v_message where session_id not in (select session_id from v_reset)", "v_message", "v_reset"
    ),
    "session_log": _sql(
        "select * from v_message where cast(substr(session_id, 2) as bigint) % 3 > 0 or message_id > 4", "v_message"
    ),
    "session_registry": _sql(
        """select session_id, min(message_id) first_message_id from v_message
where cast(substr(session_id, 2) as bigint) % 3 > 0 or message_id > 4 group by session_id""",
        "v_message",
    ),
    "chunk_table": _sql(
        "select doc_id, chunk_no, section, text from v_chunk where doc_id % 7 > 0",
        *CHUNKS,
        v_line=VIEWS["v_line"].replace("from documents", f"from ({CHANGED_DOCUMENTS})"),
    ),
    "transcript_render": _sql(
        f"""select session_id, 'model: desk-1' || chr(10) || chr(10) || string_agg('**' ||
   case when role = 'user' then '{V.ROLE_CUSTOMER}' else '{V.ROLE_AGENT}' end || ':** ' || content || chr(10), chr(10)
   order by message_id) transcript
from (select *, row_number() over (partition by session_id order by message_id desc) b from v_long)
where b <= {V.HISTORY_LIMIT} group by session_id""",
        "v_long",
    ),
    "prompt_context": _sql(
        f"""select session_id, cast(to_json([{{role: 'system', content: 'Atendimento. Hoje: 02/09/1998.'}}]
   || list({{role: role, content: content}} order by message_id)) as varchar) context
from (select *, row_number() over (partition by session_id order by message_id desc) b from v_long)
where b <= {V.HISTORY_LIMIT} group by session_id""",
        "v_long",
    ),
    "fallback_rate": _sql(
        """select session_id, count(*) replies, count(*) filter (trim(content) = '') fallbacks,
  count(*) filter (trim(content) = '') / count(*) rate from v_reply group by session_id""",
        "v_message", "v_reply",
    ),
    "scenario_expand": _sql(
        """select * from v_message where session_id not in (select 's' || doc_id from documents)
union all
select 's' || doc_id, unnest(range(0, len(string_split(text, chr(10))))), 'user', unnest(string_split(text, chr(10))) from documents""",
        "v_message",
    ),
    "pii_audit": r"""
select lang, source, count(*) texts, count(*) filter (e + p > 0) flagged, cast(sum(e) as bigint) emails, cast(sum(p) as bigint) phones
from (select lang, source, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) e,
   len(regexp_extract_all(text, '\(?[0-9]{2,3}\)?[ .-]?[0-9]{3,5}[ .-][0-9]{4}')) p from documents)
group by all""",
    "route_queries": _sql("select request_id, q, entity, kind from v_routed", *ROUTED),
    "route_and_answer": _sql(
        "select * from v_answered", *ANSWER, v_search=ROUTED_SEARCH, v_payload=WHOLE_ORDERS_JSON, v_route_request=WHOLE_REQUESTS,
        v_answer=WHOLE_ANSWER,
    ),
    "route_lists": _sql(
        """select distinct request_id, cast(way as bigint) way, key from v_found join v_routed using (request_id)
where kind in ('email', 'phone', 'customer')""",
        *ROUTED,
    ),
    "list_answers": _sql(
        f"""select cast(way as bigint) way, key, part, cast(seq as bigint) seq, payload from (
  select way, key, 'clientes' part, customer_id seq,
    cast(to_json({{customer_id: customer_id, name: name, city: city, phone: phone, email: email}}) as varchar) payload
  from (select way, key, customer_id, {MASK} from v_list join v_customer using (customer_id))
  union all
  select way, key, 'pedidos', row_number() over (partition by way, key order by customer_id, {NEWEST}), payload
  from v_list join v_payload using (customer_id))""",
        *ROUTED, *DUE, "v_product", "v_item", "v_payload", "v_list",
    ),
    "context_load": _sql(
        f"""select source, doc_id, key, part, cast(seq as bigint) seq, payload from (
select 'manual' source, doc_id, key, case when found then 'secoes' else 'secoes_disponiveis' end part, section_no seq,
  case when found then cast(to_json({{secao: section, texto: body}}) as varchar) else section end payload from v_retrieved
union all
select 'catalogo', null, key, 'produtos', rank, cast(to_json({{{BRIEF}}}) as varchar) from v_page
union all
select 'catalogo', null, key, 'total', 0, cast(count(p.key) as varchar) from v_page_key left join v_page p using (key) group by key
union all
select 'catalogo', null, '', 'produtos', row_number() over (order by price_brl, product_id), cast(to_json({{nome: name,
  categoria: category, preco_brl: cast(price_brl as double), promo: {PROMO_JSON}}}) as varchar)
from (select * from v_catalogue where status in ('active', 'coming_soon'))
union all
select 'catalogo', null, '', 'categorias', row_number() over (order by name, category_id), cast(to_json({{category_id: category_id, name: name,
  description: 'linha ' || name, product_count: n}}) as varchar)
from (select c.category_id, c.name, count(p.product_id) n from v_category c
      left join v_product p on p.category_id = c.category_id and p.status = 'active' group by all)
union all select 'catalogo', null, '', 'nota', 0, {_q(V.INDEX_NOTE)}
union all
select 'promocoes', null, '', 'promocoes', row_number() over (order by discount_percent desc, promotion_id, product_id, promo_name), cast(to_json({{product: product, promo_name: promo_name,
  original_price_brl: cast(original_price_brl as double), discount_percent: cast(discount_percent as double),
  promo_price_brl: cast(promo_price_brl as double)}}) as varchar) from v_active_promo
union all
select distinct 'fonte' || p_size, null, '', 'error', 0, '{V.UNKNOWN_SOURCE}' || 'fonte' || p_size from part where p_partkey % 4 = 2)""",
        *RETRIEVE, *CATALOGUE, "v_active_promo", "v_page_key", "v_page",
    ),
    "tool_calls_batch": _sql(
        f"""select request_id call_id, part, cast(seq as bigint) seq, payload from v_answered
union all
select call_id, 'context', 0, cast(to_json({{source: 'manual', doc_id: doc_id, key: k}}) as varchar) from v_call where event_type = 'click'
union all
select call_id, case when even then 'context' else 'error' end, 0, case when even
  then cast(to_json({{source: 'catalogo', doc_id: null, key: ''}}) as varchar) else 'TypeError: missing argument source' end
from v_call where event_type = 'signup'
union all
select call_id, 'error', 0, case when even then '{V.UNKNOWN_TOOL}drop_table'
  when broken then 'JSONDecodeError: arguments are not valid JSON' else 'TypeError: unexpected argument q' end
from v_call where event_type = 'error'""",
        "v_call", *ANSWER, v_route_request=CALLED, v_search=CALLED_SEARCH,
    ),
    "json_props": """select event_id, case when event_type <> 'error' then json_extract_string(props, '$.k') end k,
  case when event_type = 'error' then substr(props, 2) end unparsed from events""",
    "ingest_trim_null": _sql(
        """select cast(customer_id as varchar) customer_id, name || ' "x", y' || chr(10) || ' z' as name,
  case when customer_id % 3 > 0 then phone end phone, case when customer_id % 4 > 0 then email end email, city from v_customer""",
        "v_customer",
    ),
    "ingest_typed_cast": _sql(
        """select product_id, name, case when product_id % 9 > 0 then cast(category_id as bigint) end category_id,
  case when product_id % 7 > 0 then cast(price_brl as double) end price_brl,
  case when product_id % 8 > 0 then cast(stock_quantity as bigint) end stock_quantity,
  case when product_id % 8 > 0 then cast(stock_quantity as bigint) else 0 end stock_filled,
  status, specs_raw, case when product_id % 5 > 0 then cast(created_at as varchar) end created_at,
  concat_ws(',', case when product_id % 9 = 0 then 'category_id' end, case when product_id % 7 = 0 then 'price_brl' end,
     case when product_id % 5 = 0 then 'created_at' end) cast_errors from v_product""",
        "v_product",
    ),
    "load_counts": _sql(
        """select 'categories' as table, count(*) as rows from v_category union all select 'products', count(*) from part
union all select 'customers', count(*) from v_customer union all select 'orders', count(*) from orders
union all select 'order_items', count(*) from lineitem union all select 'promotions', count(*) from lineitem
union all select 'policy_chunks', count(*) from v_chunk""".replace("as table", 'as "table"').replace("as rows", 'as "rows"'),
        "v_category", "v_customer", *CHUNKS,
    ),
    "dq_state_audit": _sql(
        """select * from (
select 'policy_chunks' as "table", 'not_null(section)' as rule, 0::bigint as violations
union all select 'policy_chunks', 'not_null(text)', 0
union all select 'policy_chunks', 'unique(doc_id, chunk_no)', count(distinct doc_id) from v_chunk where doc_id % 10 = 0
union all select 'sessions', 'not_null(created_at)', 0
union all select 'sessions', 'unique(session_id)', 0
union all select 'messages', 'not_null(session_id)', 0
union all select 'messages', 'not_null(role)', count(*) from v_message where role is null
union all select 'messages', 'not_null(content)', count(*) from v_message where message_id <= 1 or content is null
union all select 'messages', 'not_null(created_at)', 0
union all select 'messages', 'unique(session_id, message_id)', count(*) from (
  select 1 from v_message group by session_id, message_id having count(*) > 1)
union all select 'messages', 'linked(session_id)', 0
union all select 'messages', 'references(session_id)', count(*) from v_message where cast(substr(session_id, 2) as bigint) % 4 = 0)""",
        "v_message", *CHUNKS,
    ),
    "dq_constraint_audit": _sql(
        """select * from (
select 'categories' as "table", 'not_null(name)' as rule, 0::bigint as violations
union all select 'categories', 'unique(category_id)', count(*) from (select category_id from v_category group by 1 having count(*) > 1)
union all select 'products', 'not_null(name)', count(*) from v_product where name is null
union all select 'products', 'not_null(price_brl)', count(*) from v_product where stock_quantity <= 0
union all select 'products', 'not_null(stock_quantity)', count(*) from v_product where stock_quantity is null
union all select 'products', 'not_null(status)', count(*) from v_product where status is null
union all select 'products', 'unique(product_id)', count(*) from (select product_id from v_product group by 1 having count(*) > 1)
union all select 'products', 'references(category_id)', count(*) from v_product where product_id % 50 = 7
union all select 'products', 'linked(category_id)', count(*) from v_product where product_id % 50 = 8
union all select 'products', 'indexed(product_id)', 1 + count(*) from v_product where product_id % 30 = 0
union all select 'orders', 'linked(customer_id)', 0
union all select 'order_items', 'linked(order_id)', 0
union all select 'order_items', 'linked(product_id)', 0
union all select 'promotions', 'linked(product_id)', 0
union all select 'customers', 'not_null(name)', count(*) from v_customer where name is null
union all select 'customers', 'unique(customer_id)', count(*) from (select customer_id from v_customer group by 1 having count(*) > 1)
union all select 'orders', 'unique(order_id)', count(*) from (select o_orderkey from orders group by 1 having count(*) > 1)
union all select 'orders', 'references(customer_id)', count(*) from orders where o_orderkey % 40 = 3
  or o_custkey not in (select customer_id from v_customer)
union all select 'order_items', 'references(order_id)', count(*) from v_item where order_id not in (select o_orderkey from orders)
union all select 'order_items', 'references(product_id)', count(*) from v_item where quantity = 13
  or product_id not in (select product_id from v_product)
union all select 'promotions', 'not_null(is_active)', count(*) from v_promo where is_active is null
union all select 'promotions', 'unique(promotion_id)', count(*) from (select promotion_id from v_promo group by 1 having count(*) > 1)
union all select 'promotions', 'references(product_id)', count(*) from v_promo where product_id not in (select product_id from v_product))""",
        "v_category", "v_product", "v_promo", "v_customer", "v_item",
    ),
}
