"""SQL counterparts of the queries that SQL can express.

Model fits, hash fingerprints and packing plans have none; their queries are tested against
plain versions instead.
"""

from quarrylamp.llm.licences import COPYRIGHT, SENTENCE, SPELLINGS, notices, whole_texts

_WORDS = r"list_filter(string_split_regex({}, '[ \t-\r]+'), lambda x: x <> '')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(line: str) -> str:
    return _spelled(rf"trim(regexp_replace(lower({line}), '[^\p{{L}}\p{{N}}©]+', ' ', 'g'))")


def _spelled(plain: str) -> str:
    for spelling, common in SPELLINGS:
        plain = f"replace({plain}, {_quoted(spelling)}, {_quoted(common)})"
    return plain


def _licences() -> str:
    known = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in notices() + whole_texts())
    return rf"""
        with texts as (
            select 'known' as side, licence as name, null::bigint as doc_id, text from (values {known}) t(licence, text)
            union all select 'documents', null, doc_id, coalesce(text, '') from documents
        ), lines as (
            select side, name, doc_id, list_filter(list_transform(
                list_transform(string_split(text, chr(10)), lambda l: {_canonical("l")}),
                lambda p: case when regexp_matches(p, '{COPYRIGHT}')
                          and not regexp_matches(p, '^copyright ({"|".join(SENTENCE)})s?( |$)') then '' else p end), lambda p: p <> '') as parts
            from texts
        ), known as (
            select {_spelled("array_to_string(parts, ' ')")} as whole, min(name) as licence from lines
            where side = 'known' and len(parts) > 0 group by 1
        ), units as (
            select doc_id, {_spelled("array_to_string(parts, ' ')")} as unit, true as is_whole from lines where side = 'documents' and len(parts) > 0
            union all select doc_id, unnest(parts), false from lines where side = 'documents'
        ), found as (
            select doc_id, min(case when is_whole then licence end) as whole_licence,
                   list_sort(list_distinct(list(licence))) as names
            from units join known on unit = whole group by doc_id
        )
        select doc_id, whole_licence, coalesce(array_to_string(names, ','), '') as licences,
               coalesce(len(names), 0)::int as n_licences
        from (select distinct doc_id from documents) left join found using (doc_id)
    """


ORACLES: dict[str, str] = {
    "op6_licences": _licences(),
    "op8_kdsearch": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
            where embedding is not null and len(embedding) > 0
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from v q join v c on q.vec_id <> c.vec_id and q.vec_id % 50 = 0
        )
        select query_id, rank::int as rank, vec_id, score from (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        ) where rank <= 5
    """,
    "op9_mixing": rf"""
        with sized as (
            select doc_id, source, len({_WORDS.format("coalesce(text, '')")})::bigint as size from documents
        ), weighed as (
            select source, sum(size)::bigint as source_size, 3.0::double * sum(size) as most,
                   ([1.0, 2.0, 3.0])[((row_number() over (order by source nulls last) - 1) % 3)::int + 1]::double as weight
            from sized group by source
        ), steps as (
            select most / weight as fills_at,
                   (sum(source_size) over () - coalesce(sum(most) over before, 0)) /
                   (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
            from weighed
            window before as (order by most / weight rows between unbounded preceding and 1 preceding)
        ), aims as (
            select source, source_size, block, ceil(source_size / block)::bigint as blocks,
                   least(most, weight * level) as target
            from (select *, greatest(1, least(1024, source_size // 1024)) as block from weighed),
                 (select arg_min(level, fills_at)::double as level from steps where fills_at >= level)
        ), stretches as (
            select source, blocks, sum(target / block) over (order by source nulls last) as upto, target / block as slots,
                   sum(target / block) over () as total
            from aims where target > 0
        ), slots as (
            select i as slot, list_sum(list_transform(range(1, 49), lambda k: ((i >> (k - 1)) & 1)::double / pow(2, k))) as point
            from range((select round(max(total))::bigint from stretches)) t(i)
        ), turns as (
            select source, blocks, row_number() over (partition by source order by slot) - 1 as turn
            from slots join stretches on point >= (upto - slots) / total
             and point < case when upto = total then 2.0 else upto / total end
        ), times as (
            select source, turn % blocks as block_no, count(*) as times from turns where turn < 3 * blocks group by 1, 2
        ), laid as (
            select doc_id, source, size, row_number() over () as row,
                   coalesce(sum(size) over (partition by source order by md5(doc_id::varchar), doc_id, size
                            rows between unbounded preceding and 1 preceding), 0)::bigint as start
            from sized
        ), pieces as (
            select l.*, source_size, target, block,
                   unnest(range(start // block, greatest(start // block, (start + size - 1) // block) + 1)) as block_no
            from laid l join aims a on l.source is not distinct from a.source
        )
        select doc_id, any_value(size) as size, any_value(source_size) as source_size, any_value(target) as target,
               sum(greatest(0, least(start + size, (p.block_no + 1) * block) - greatest(start, p.block_no * block))
                   * coalesce(times, 0))::bigint as taken
        from pieces p left join times t on p.source is not distinct from t.source and p.block_no = t.block_no
        group by row, doc_id
    """,
    "op11_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: floor(x::double * 256)) as v from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, c.vec_id, a.label = c.label as same, list_dot_product(a.v, c.v)::bigint as score
            from v a join v c on a.vec_id <> c.vec_id and a.vec_id % 100 = 0
        ), positives as (
            select anchor_id, vec_id as positive_id, score as positive_score from (
                select *, row_number() over (partition by anchor_id order by score desc, vec_id) as rank from scored where same
            ) where rank <= 5
        ), ranked as (
            select p.*, s.vec_id as negative_id, s.score as negative_score,
                   row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id) as rank
            from positives p join scored s on p.anchor_id = s.anchor_id and not s.same
             and 100 * s.score between 30 * positive_score and 90 * positive_score
        )
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score
        from ranked where rank <= 10
    """,
}
