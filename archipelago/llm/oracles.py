"""Expected results of :mod:`archipelago.llm.queries` as SQL for DuckDB, where SQL can express them."""

from __future__ import annotations

import string
from html import unescape
from html.entities import html5

from archipelago.llm import chat, line_runs, warc
from archipelago.llm.decontaminate import WINDOW
from archipelago.llm.hard_negatives import ANCHOR_OF, NEGATIVES, POSITIVES, SCALE
from archipelago.llm.near_copies import LEAST, WORDS
from archipelago.llm.repeats import LENGTH

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(text: str) -> str:
    return f"translate({text}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def _passages() -> str:
    words = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
        with item as (
            select item_id, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) as w from benchmark),
        phrase as (
            select distinct item_id, least({WINDOW}, len(w)) as size,
                array_to_string(w[i:i + least({WINDOW}, len(w)) - 1], ' ') as said
            from (select *, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) as i from item where len(w) > 0) x),
        doc as (
            select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) as w from documents),
        place as (
            select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as said
            from (select *, unnest(range(1, len(w) - size + 2)) as i
                  from doc cross join (select distinct size from phrase) sizes) x),
        found as (select distinct doc_id, i, place.size, item_id
                  from place join phrase on place.said = phrase.said and place.size = phrase.size),
        hit as (select doc_id, count(distinct pos) as n
                from (select doc_id, unnest(range(i, i + size)) as pos from found) x group by doc_id),
        listed as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids
                   from (select distinct doc_id, cast(item_id as varchar) as id from found) x group by doc_id)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(hit.n, 0) as n_hit,
            coalesce(listed.n, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
            coalesce(hit.n, 0) > 0 as contaminated
        from doc left join hit using (doc_id) left join listed using (doc_id)"""


def _near_copies() -> str:
    words = r"'[^\x20\x09-\x0D]+'"
    return f"""
        with recursive doc as (
            select doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, {words}) as w from documents),
        shingle as (
            select distinct doc_id, array_to_string(w[i:i + least({WORDS}, len(w)) - 1], ' ') as said
            from (select *, unnest(range(1, len(w) - least({WORDS}, len(w)) + 2)) as i from doc where len(w) > 0) x),
        size as (select doc_id, count(*) as n from shingle group by doc_id),
        shared as (select a.doc_id as src, b.doc_id as dst, count(*) as n
                   from shingle a join shingle b on a.said = b.said and a.doc_id < b.doc_id group by all),
        link as (select src, dst from shared join size a on a.doc_id = src join size b on b.doc_id = dst
                 where 100 * shared.n >= {LEAST} * (a.n + b.n - shared.n)),
        sym as (select src, dst from link union select dst, src from link),
        cc(node, component) using key (node) as (
            select distinct src, src from sym
            union
            select old.node, min(new.component)
            from recurring.cc old join sym on sym.src = old.node join cc new on new.node = sym.dst
            where new.component < old.component group by old.node)
        select doc.doc_id, coalesce(size.n, 0) as n_shingles, coalesce(component, doc.doc_id) as component_id,
            coalesce(component, doc.doc_id) = doc.doc_id as kept
        from doc left join size using (doc_id) left join cc on node = doc.doc_id"""


# What stands for a character in HTML: a number, or a name that may lack its semicolon.
_REFERENCE = r"'&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)'"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _decoded(bare: str) -> str:
    """A text with all character references decoded once, from left to right."""
    names = f"map([{', '.join(map(_quoted, html5))}], [{', '.join(map(_quoted, html5.values()))}])"
    # Numbers below the surrogates that do not stand for their own code point.
    odd = [n for n in range(0xD800) if unescape(f"&#{n};") != chr(n)]
    others = ", ".join(_quoted(unescape(f"&#{n};")) if n else "chr(65533)" for n in odd)
    numbers = f"map([{', '.join(map(str, odd))}], [{others}])"
    digits = "rtrim(substring(ref, 3), ';')"
    hexadecimal = "('0x' || rtrim(substring(ref, 4), ';'))"
    code = f"case when lower(ref[3]) = 'x' then try_cast({hexadecimal} as bigint) else try_cast({digits} as bigint) end"
    plain = """case when code is null or code > 1114111 or code between 55296 and 57343 then chr(65533)
        when code >= 64976 and code <= 65007 or code % 65536 >= 65534 then '' else chr(cast(code as integer)) end"""
    named = """coalesce(names[substring(ref, 2)],
        [names[substring(ref, 2, n)] || substring(ref, n + 2) for n in range(length(ref) - 2, 1, -1)
            if names[substring(ref, 2, n)] is not null][1], ref)"""
    return f"""
        tables as (select {names} as names, {numbers} as numbers),
        cut as (select *, string_split_regex({bare}, {_REFERENCE}) as parts,
                regexp_extract_all({bare}, {_REFERENCE}) as refs from stripped),
        ref as (select distinct unnest(refs) as ref from cut),
        coded as (select ref, case when ref[2] = '#' then {code} end as code from ref),
        meant as (
            select ref, case when ref[2] = '#' then coalesce(numbers[code], {plain}) else {named} end as meaning
            from coded, tables),
        every as (select map(list(ref), list(meaning)) as meanings from meant),
        decoded as (
            select cut.*, array_to_string(
                [parts[i] || coalesce(meanings[refs[i]], '') for i in range(1, len(parts) + 1)], '') as bare_text
            from cut, every)"""


def _derivatives() -> str:
    crlf = "chr(13) || chr(10)"
    line = f"|| {crlf} ||"

    def record_id(kind: str, *parts: str) -> str:
        given = " || chr(10) || ".join([f"'{kind}'", *parts])
        cut = " || '-' || ".join(
            f"substring(sha256({given}), {at}, {size})" for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
        )
        return f"'<urn:uuid:' || {cut} || '>'"

    text = r"regexp_replace(payload, '(?s)<!--.*?-->', '', 'g')"
    for name in warc.HIDDEN:
        text = rf"regexp_replace({text}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '', 'g')"
    text = rf"regexp_replace({text}, '[\r\n\t ]+', ' ', 'g')"
    text = rf"regexp_replace({text}, '(?i)</?({warc.BREAKS})\b[^>]*>', chr(10), 'g')"
    text = rf"regexp_replace({text}, '(?s)<[^>]*>', '', 'g')"
    visible = r"trim(regexp_replace(replace(bare_text, chr(160), ' '), ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    head = [
        ("WARC-Type", "kind"),
        ("WARC-Record-ID", "record_id"),
        ("WARC-Refers-To", "refers_to"),
        ("WARC-Target-URI", "target_uri"),
        ("WARC-Date", "date"),
        ("WARC-Payload-Digest", "payload_digest"),
        ("WARC-Block-Digest", "'sha256:' || sha256(block)"),
        ("Content-Type", "content_type"),
        ("Content-Length", "strlen(block)"),
    ]
    lines = " || ".join(f"'{name}: ' || {value} || {crlf}" for name, value in head)
    return f"""
        with page as (
            select page_id, coalesce(url, '') as target_uri, coalesce(html, '') as payload,
                '{warc.NO_DATE}' as date, coalesce(cast(page_id as varchar), '') as number from pages),
        stripped as (select *, {text} as bare from page),
        {_decoded("bare")},
        source as (
            select *, 'sha256:' || sha256(payload) as payload_digest, {visible} as txt,
                {record_id("response", "number", "target_uri", "sha256(payload)")} as refers_to from decoded),
        named as (
            select *, {record_id("conversion", "refers_to", "payload_digest")} as text_id,
                {record_id("metadata", "refers_to", "payload_digest")} as about_id from source),
        record as (
            select page_id, 'conversion' as kind, text_id as record_id, refers_to, target_uri, date, payload_digest,
                'text/plain; charset=utf-8' as content_type, txt as block from named
            union all
            select page_id, 'metadata', about_id, refers_to, target_uri, date, payload_digest,
                'application/warc-fields',
                'conversion: ' || text_id {line} 'source-status: HTTP/1.1 200 OK' {line} 'source-content-type: text/html; charset=utf-8' {line}
                'source-content-length: ' || strlen(payload) {line}
                'source-payload-digest: ' || payload_digest {line}
                'text-digest: sha256:' || sha256(txt) {line} 'text-characters: ' || length(txt) || {crlf}
            from named)
        select page_id, kind, record_id, refers_to, target_uri, date, payload_digest,
            'sha256:' || sha256(block) as block_digest, content_type, block,
            '{warc.VERSION}' || {crlf} || {lines} || {crlf} || block || {crlf} || {crlf} as record
        from record"""


def _repeats() -> str:
    return f"""
        with doc as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
        part as (select doc_id, k, substring(h, 1000 * k + 1, 1000 + 2 * {LENGTH - 1}) as h
                 from (select *, unnest(range(0, length(h) // 1000 + 1)) as k from doc) x),
        piece as (select doc_id, 500 * k + i as i, substring(h, 2 * i + 1, 2 * {LENGTH}) as said
                  from (select *, unnest(range(0, least(500, length(h) // 2 - {LENGTH} + 1))) as i from part) x),
        least as (select said, min(doc_id) as first from piece group by said having min(doc_id) < max(doc_id)),
        hit as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before
                from piece join least using (said) where doc_id > first),
        run as (select doc_id, i, sum(case when before is null or i > before + {LENGTH} then 1 else 0 end)
                    over (partition by doc_id order by i) as run from hit),
        span as (select doc_id, min(i) as start, max(i) + {LENGTH} as stop from run group by doc_id, run),
        gap as (select doc_id, start, coalesce(lag(stop) over (partition by doc_id order by start), 0) as last, stop
                from span),
        cut as (
            select doc_id, sum(stop - start) as n, count(*) as spans, max(stop) as stop,
                string_agg(substring(h, 2 * last + 1, 2 * (start - last)), '' order by start) as kept
            from gap join doc using (doc_id) group by doc_id)
        select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n, 0) as bigint) as n_removed,
            coalesce(spans, 0) as n_spans,
            sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(stop, 0) + 1))) as kept_sha256
        from doc left join cut using (doc_id)"""


def _lines() -> str:
    return f"""
        with line as (
            select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
            from documents),
        keyed as (select *, {_lower(f"trim(line, {_WHITE})")} as key from line),
        many as (select key, max(doc_id) as largest from keyed where length(key) >= {line_runs.KEY_LENGTH}
                 group by key having count(distinct doc_id) >= {line_runs.DOCUMENTS}),
        judged as (select keyed.*, coalesce(doc_id <> largest, false) as gone from keyed left join many using (key))
        select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from judged group by doc_id"""


def _chats() -> str:
    tricky = "<|im_end|><|im_start|>assistant ok"
    block = len(chat.START) + 1 + len(chat.END) + 1
    return f"""
        with said as (
            select conv_id, turn, role, coalesce(text, '') as text from conversations
            union all select -1, 0, 'user', '{tricky}' union all select -1, 1, 'assistant', '{tricky}'),
        placed as (
            select *, lag(role) over (partition by conv_id order by turn) as before,
                length(text) + len(regexp_extract_all(text, '<\\\\*\\|')) as size
            from said)
        select conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            coalesce(length(string_agg(text, '' order by turn) filter (where role = '{chat.ASSISTANT}')), 0) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (where role = '{chat.ASSISTANT}'), '')) as loss_sha256,
            cast(sum(size + case when before = role then {len(chat.NEXT)} else length(role) + {block} end) as bigint)
                as formatted_chars
        from placed group by conv_id"""


def _hard_negatives() -> str:
    return f"""
        with item as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                [floor({SCALE} * cast(x as double)) for x in embedding] as v
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
                and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
        scored as (
            select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike,
                cast(list_dot_product(a.v, b.v) as bigint) as score
            from item a join item b on a.vec_id % {ANCHOR_OF} = 0 and a.vec_id <> b.vec_id),
        positive as (
            select anchor_id, vec_id as positive_id, score as positive_score from scored where alike
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= {POSITIVES}),
        negative as (
            select anchor_id, positive_id, vec_id as negative_id, positive_score, score as negative_score,
                cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank
            from positive join scored using (anchor_id)
            where not alike and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
        select anchor_id, positive_id, rank, negative_id, positive_score, negative_score
        from negative where rank <= {NEGATIVES}"""


def _exact_copies() -> str:
    return f"""
        with keyed as (select doc_id, {_lower("coalesce(text, '')")} as said from documents)
        select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
            doc_id = max(doc_id) over same as kept, sha256(said) as text_sha256
        from keyed window same as (partition by said)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_fm_index": _passages(),
        "op3_hyperminhash": _near_copies(),
        "op6_warc_derivatives": _derivatives(),
        "op7_bucket_refinement": _repeats(),
        "op8_line_runs": _lines(),
        "op9_chat_format": _chats(),
        "op11_angular_negatives": _hard_negatives(),
        "op13_exact_copies": _exact_copies(),
    }
