"""SQL counterparts of the registered queries, for an independent engine on the same tables.

They state each result the plain way (all pairs compared, dynamic programming tables, joins on line
ranges), share only the input views and fixed values with the library, and cover the whole tables.
"""

from __future__ import annotations

from twinscan.functions import languages, tokens
from twinscan.operators import functions as fn
from twinscan.operators import tokenize as tk
from twinscan.plans.bindings import view_sql

ORACLES: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def names(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def case_of(column: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def with_(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


SUBS = f"s AS ({view_sql('submissions')})"
COMPS = f"c AS ({view_sql('comparisons')})"
PROSE = f"p AS ({view_sql('prose_files')})"
PAGES = f"g AS ({view_sql('page_files')})"
SOURCE = (
    f"f AS (SELECT *, CASE WHEN ends_with(path, '.py') THEN 'python' ELSE 'javascript' END AS language "
    f"FROM ({view_sql('source_files')}))"
)

# ---- tokens ----------------------------------------------------------------------------------------

_OPERATOR_TYPE = """CASE WHEN lex IN ('==','!=','===','!==','<','>','<=','>=') THEN 'comparison_operator'
    WHEN lex IN ('+=','-=','*=','/=','%=','++','--') THEN 'augmented_assignment'
    WHEN lex IN ('&&','||','!') THEN 'boolean_operator' WHEN lex = '=' THEN 'assignment'
    WHEN lex IN ('=>','->') THEN 'arrow' ELSE 'binary_operator' END"""
_NUMBER_TYPE = "WHEN regexp_matches(lex, '^[0-9]') THEN CASE WHEN contains(lex, '.') THEN 'float' ELSE 'integer' END"


def lexemes(src: str, keys: str, pattern: str) -> str:
    return f"""ln AS (SELECT {keys}, unnest(l) AS line, unnest(range(len(l))) AS row
        FROM (SELECT {keys}, string_split(content, chr(10)) AS l FROM {src})),
    lx AS (SELECT {keys}, row, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, unnest(x) AS lex, unnest(range(len(x))) AS k
        FROM (SELECT *, {pattern} AS x FROM ln))"""


def extract_all(family: str) -> str:
    return f"regexp_extract_all(line, {q(tk.LEXEMES[family])})"


TEXT_TOKENS = (
    lexemes("p", "project, group_id, file_id", extract_all("text"))
    + f""", tok AS (SELECT *, lex AS text, CASE {_NUMBER_TYPE}
        WHEN regexp_matches(lex, '^[\\p{{L}}_]') THEN coalesce({case_of('lex', tk.WORD_TYPES)}, 'word')
        ELSE {_OPERATOR_TYPE} END AS type FROM lx)"""
)
MARKUP_TOKENS = (
    lexemes("g", "file_id", extract_all("markup"))
    + f""", tok AS (SELECT *, lex AS text, CASE {_NUMBER_TYPE} WHEN starts_with(lex, '<!--') THEN 'comment'
        WHEN starts_with(lex, '</') THEN 'end_tag' WHEN starts_with(lex, '<') THEN 'start_tag'
        WHEN ends_with(lex, '"') THEN 'attribute' ELSE 'word' END AS type FROM lx)"""
)
SOURCE_TOKENS = (
    lexemes(
        "f",
        "project, submission_id, group_id, language, path, file_id",
        f"CASE WHEN language = 'python' THEN {extract_all('hash')} ELSE {extract_all('slash')} END",
    )
    + f""", lw AS (SELECT *, regexp_replace(lex, '[ ]*\\($', '') AS word, regexp_matches(lex, '^[A-Za-z_]') AS is_word FROM lx),
    lk AS (SELECT *, CASE WHEN is_word THEN {case_of('word', tk.WORD_TYPES)} END AS kw FROM lw),
    tok AS (SELECT *, CASE {_NUMBER_TYPE}
            WHEN (language = 'python' AND starts_with(lex, '#')) OR (language <> 'python' AND (starts_with(lex, '//') OR starts_with(lex, '/*'))) THEN 'comment'
            WHEN left(lex, 1) IN ('"', '''') THEN 'string'
            WHEN is_word THEN coalesce(kw, CASE WHEN ends_with(lex, '(') THEN 'call' ELSE 'identifier' END)
            ELSE {_OPERATOR_TYPE} END AS type,
        CASE WHEN kw IN {names(dict.fromkeys(tk.STATEMENT_WORDS.values()))} AND starts_with(line, word) THEN line
            WHEN kw IS NOT NULL THEN word WHEN is_word AND ends_with(lex, '(') THEN word || '()'
            WHEN lex = '=' THEN line ELSE lex END AS text FROM lk)"""
)
_T = "text"
_REWRITE = f"""CASE
    WHEN type = 'function_definition' THEN regexp_replace({_T}, 'def\\s+\\w+\\([^)]*\\):', 'def func(params):', 'g')
    WHEN type = 'class_definition' THEN regexp_replace({_T}, 'class\\s+\\w+:', 'class Class:', 'g')
    WHEN type = 'return_statement' THEN CASE WHEN contains({_T}, 'return') AND contains({_T}, ' ') THEN 'return expr' ELSE {_T} END
    WHEN type = 'assignment' THEN regexp_replace({_T}, '\\w+\\s*=\\s*.+', 'var = expr', 'g')
    WHEN type IN ('if_statement', 'elif_clause') THEN regexp_replace({_T}, '(if|elif)\\s+.+:', '\\1 condition:', 'g')
    WHEN type = 'for_statement' THEN regexp_replace({_T}, 'for\\s+\\w+\\s+in\\s+.+:', 'for item in iterable:', 'g')
    WHEN type = 'while_statement' THEN regexp_replace({_T}, 'while\\s+.+:', 'while condition:', 'g')
    WHEN type = 'call' THEN regexp_replace({_T}, '\\w+\\([^)]*\\)', 'func(args)', 'g')
    ELSE {_T} END"""


def _operator_class(math, logic) -> str:
    return (
        f"CASE WHEN text IN {names(math)} THEN 'MATH_OP' WHEN text IN {names(tokens.COMPARE)} THEN 'COMPARE_OP' "
        f"WHEN text IN {names(logic)} THEN 'LOGIC_OP' ELSE 'OPERATOR' END"
    )


PREPARED = f"""pre AS (SELECT *, {case_of('type', tokens.PLACEHOLDERS)} AS holder FROM tok WHERE type NOT IN ('comment', 'ERROR')),
    sig AS (SELECT *, CASE WHEN holder IS NOT NULL THEN holder ELSE type || ':' || rw END AS part,
        {case_of('type', tokens.STRUCTURAL, 'upper(type)')} AS struct_,
        CASE WHEN type IN {names(tokens.FLOW_TYPES)} THEN type END AS flow_,
        CASE WHEN type IN {names(tokens.WORD_OPERATOR_TYPES)} THEN {_operator_class(tokens.WORD_MATH, tokens.WORD_LOGIC)}
            WHEN type IN {names(tokens.CALL_TYPES)} THEN 'METHOD_CALL' END AS op_
        FROM (SELECT *, {_REWRITE} AS rw FROM pre))"""


def features(keys: str, source: str = "sig", name: str = "ft") -> str:
    def seq(c: str) -> str:
        return f"coalesce(string_agg({c}, ' ' ORDER BY row, k) FILTER ({c} IS NOT NULL), '')"

    return f"""{name} AS (SELECT {keys}, string_split(string_agg(part, ' | ' ORDER BY row, k), ' | ') AS parts,
        {seq('type')} AS types, {seq('struct_')} AS structural, {seq('flow_')} AS flow, {seq('op_')} AS ops
        FROM {source} GROUP BY {keys})"""


def jaccard(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE)"


SCOPE = "project, language"
# A class: all its groups, and its first and last row by (group, id). Of two classes, a is the one whose first
# row comes first; it gives that row and b its last one, unless these are of one group: then the other way round.
_RANGE = """list(DISTINCT group_id) AS gs, min(ROW(group_id, file_id)) AS lo, max(ROW(group_id, file_id)) AS hi"""
_ONE_WAY = "a.lo < b.lo"
_NOT_ONE_GROUP = "len(list_distinct(list_concat(a.gs, b.gs))) > 1"
_A, _B = (f"CASE WHEN a.lo[1] <> b.hi[1] THEN {x} ELSE {y} END" for x, y in (("a.lo[2]", "a.hi[2]"), ("b.hi[2]", "b.lo[2]")))
_NAMED_PAIR = (
    f"least({_A}, {_B}) AS left_id, greatest({_A}, {_B}) AS right_id, "
    + ", ".join(
        f"CASE WHEN ({_A}) < ({_B}) THEN {x} ELSE {y} END AS {n}"
        for x, y, n in (
            ("a.copies", "b.copies", "left_copies"), ("b.copies", "a.copies", "right_copies"),
            ("a.id", "b.id", "left_class"), ("b.id", "a.id", "right_class"),
        )
    )
)
_OWN_PAIR = "least(lo[2], hi[2]), greatest(lo[2], hi[2]), copies, copies, id, id"
SOURCE_CLASSES = (
    features("project, language, group_id, file_id")
    + f""", cl AS (SELECT project, language, parts, types, structural, flow, ops, count(*) AS copies, min(file_id) AS id,
        {_RANGE} FROM ft GROUP BY ALL),
    cs AS (SELECT *, list_distinct(list_filter(parts, lambda x: trim(x) <> '')) AS pset FROM cl)"""
)
SOURCE_PAIRS = (
    SOURCE_CLASSES
    + f""", sp AS (SELECT a.project, a.language, {_NAMED_PAIR},
        {jaccard('a.pset', 'b.pset')} AS jaccard_similarity
        FROM cs a JOIN cs b ON a.project = b.project AND a.language = b.language AND {_ONE_WAY} AND {_NOT_ONE_GROUP}
        WHERE {jaccard('a.pset', 'b.pset')} >= 0.8
        UNION ALL SELECT project, language, {_OWN_PAIR}, 1.0 FROM cs WHERE len(gs) > 1)"""
)


def lcs(wanted: str) -> str:
    """`lc`(a, b, n): LCS length of the distinct, different, non-empty sequence pairs (a, b) of `wanted`."""
    return f"""lw1 AS (SELECT DISTINCT a, b FROM ({wanted}) WHERE a <> b AND a <> '' AND b <> ''),
    lp AS (SELECT row_number() OVER () AS pid, a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM lw1),
    la AS (SELECT pid, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM lp),
    lb AS (SELECT pid, unnest(y) AS v, unnest(range(1, len(y) + 1)) AS j FROM lp),
    dp AS (SELECT pid, CAST(0 AS BIGINT) AS i, unnest(range(0, len(y) + 1)) AS j, CAST(0 AS BIGINT) AS v FROM lp
        UNION ALL
        SELECT pid, i, j, max(cand) OVER (PARTITION BY pid ORDER BY j) AS v FROM (
            SELECT d.pid, la.i, d.j, CASE WHEN lb.v = la.v THEN lag(d.v) OVER (PARTITION BY d.pid ORDER BY d.j) + 1 ELSE d.v END AS cand
            FROM dp d JOIN la ON la.pid = d.pid AND la.i = d.i + 1 LEFT JOIN lb ON lb.pid = d.pid AND lb.j = d.j)),
    lc AS (SELECT lp.a, lp.b, max(dp.v) AS n FROM lp JOIN dp USING (pid) GROUP BY lp.a, lp.b)"""


def seq_len(s: str) -> str:
    return f"CASE WHEN {s} = '' THEN 0 ELSE len(string_split({s}, ' ')) END"


def lcs_score(a: str, b: str, n: str) -> str:
    return (
        f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 "
        f"ELSE {n} / CAST(greatest({seq_len(a)}, {seq_len(b)}) AS DOUBLE) END"
    )


def type_jaccard(a: str, b: str) -> str:
    return jaccard(f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))")


SEQUENCES = ["structural", "types", "flow", "ops"]
_JOIN_LCS = " ".join(f"LEFT JOIN lc l_{s} ON l_{s}.a = x.{s} AND l_{s}.b = y.{s}" for s in SEQUENCES)
_WANTED = " UNION ALL ".join(
    f"SELECT x.{s} AS a, y.{s} AS b FROM sp JOIN ft x ON x.file_id = left_id JOIN ft y ON y.file_id = right_id" for s in SEQUENCES
)
_METRICS = f"""{lcs_score('x.structural', 'y.structural', 'l_structural.n')} AS s_, {lcs_score('x.types', 'y.types', 'l_types.n')} AS q_,
    {lcs_score('x.flow', 'y.flow', 'l_flow.n')} AS f_, {lcs_score('x.ops', 'y.ops', 'l_ops.n')} AS o_,
    {type_jaccard('x.types', 'y.types')} AS t_, {seq_len('x.types')} AS n1, {seq_len('y.types')} AS n2"""
SCORED = f"""{lcs(_WANTED)},
    sc AS (SELECT sp.*, x.parts AS p1, y.parts AS p2, x.types AS ty1, y.types AS ty2, {_METRICS}
        FROM sp JOIN ft x ON x.file_id = left_id JOIN ft y ON y.file_id = right_id {_JOIN_LCS}),
    sr AS (SELECT *, least(n1, n2) / CAST(greatest(n1, n2) AS DOUBLE) AS ratio FROM sc),
    sf AS (SELECT *, CASE WHEN ratio > 0.5 THEN 1.0 WHEN ratio > 0.3 THEN 0.9 ELSE 0.8 END AS pen FROM sr)"""
_JOINED = "list_reduce({p}, lambda x, y: x || ' | ' || y)"


def _signature(p: str) -> str:
    j = f"array_to_string({p}, ' | ')"
    return f"sha256({j})"


_OVERALL = "(jaccard_similarity * 0.25 + s_ * 0.30 + q_ * 0.20 + f_ * 0.15 + o_ * 0.05 + t_ * 0.05) * pen"

# ---- functions of source files ---------------------------------------------------------------------

_PY, _JS = fn.HEADERS["python"][0], [fn.HEADERS["javascript"][0], *[p for p, _ in fn.MORE_HEADERS["javascript"]]]
_BAD = names([*fn.CONSTRUCTORS, *fn.ANNOTATIONS, *fn.NOT_NAMES])


def _usable(pattern: str) -> str:
    n = f"regexp_extract(line, {q(pattern)}, 1)"
    return f"CASE WHEN {n} <> '' AND {n} NOT IN {_BAD} THEN {n} END"


FUNCTIONS = f"""fl AS (SELECT file_id, language, unnest(l) AS line, unnest(range(len(l))) AS row
        FROM (SELECT *, string_split(content, chr(10)) AS l FROM f)),
    fb AS (SELECT *, length(regexp_extract(line, '^([ ]*)', 1)) AS indent,
        regexp_replace(regexp_replace(line, '"[^"]*"', '""', 'g'), '//.*', '') AS bare,
        CASE WHEN language = 'python' THEN {_usable(_PY)} ELSE coalesce({', '.join(_usable(p) for p in _JS)}) END AS name,
        CASE WHEN language = 'python' THEN 'function_definition' WHEN {_usable(_JS[0])} IS NOT NULL THEN 'function_declaration'
            WHEN {_usable(_JS[1])} IS NOT NULL THEN 'arrow_function' ELSE 'method_definition' END AS node
        FROM fl WHERE regexp_matches(line, '\\S')),
    fd AS (SELECT *, length(bare) - length(replace(bare, '{{', '')) AS o, length(bare) - length(replace(bare, '}}', '')) AS c_ FROM fb),
    fw AS (SELECT *, CAST(sum(o - c_) OVER (PARTITION BY file_id ORDER BY row) AS BIGINT) AS depth FROM fd),
    fe AS (SELECT h.file_id, h.language, h.name, h.node, h.row, CASE WHEN h.language = 'python' THEN
            coalesce((SELECT max(z.row) FROM fw z WHERE z.file_id = h.file_id AND z.row < (
                SELECT min(n.row) FROM fw n WHERE n.file_id = h.file_id AND n.row > h.row AND n.indent <= h.indent)),
                (SELECT max(z.row) FROM fw z WHERE z.file_id = h.file_id))
        ELSE (SELECT min(n.row) FROM fw n WHERE n.file_id = h.file_id AND n.row > h.row AND n.depth <= h.depth - h.o + h.c_) END AS last_row
        FROM fw h WHERE h.name IS NOT NULL),
    fu AS (SELECT fe.*, row_number() OVER (PARTITION BY file_id ORDER BY row, name) - 1 AS idx FROM fe),
    fc AS (SELECT fu.*, (SELECT string_agg(line, chr(10) ORDER BY fl.row) FROM fl WHERE fl.file_id = fu.file_id AND fl.row BETWEEN fu.row AND fu.last_row) AS code FROM fu)"""

SHAPES = (
    "gt AS (SELECT fu.file_id, fu.idx, fu.name, fu.row AS r0, fu.last_row AS r1, t.row, t.k, t.part, t.type, t.struct_, t.flow_, t.op_ "
    "FROM fu JOIN sig t ON t.file_id = fu.file_id AND t.row BETWEEN fu.row AND fu.last_row), "
    + features("file_id, idx, name, r0, r1", "gt", "gs")
)
_PAIRED = "FROM sp JOIN gs x ON x.file_id = sp.left_id JOIN gs y ON y.file_id = sp.right_id"
BLOCKS = f"""{lcs(' UNION ALL '.join(f'SELECT x.{s} AS a, y.{s} AS b {_PAIRED}' for s in SEQUENCES))},
    gp AS (SELECT sp.left_id, sp.right_id, x.idx AS i1, y.idx AS i2, x.name AS m1, y.name AS m2, x.r0 AS a0, x.r1 AS a1, y.r0 AS b0, y.r1 AS b1,
        x.types AS ty1, y.types AS ty2, x.ops AS op1, y.ops AS op2, {_METRICS} {_PAIRED} {_JOIN_LCS}),
    gc AS (SELECT *, (s_ * 0.4 + q_ * 0.25 + f_ * 0.2 + o_ * 0.1 + t_ * 0.05) *
        CASE WHEN least(n1, n2) / CAST(greatest(n1, n2) AS DOUBLE) > 0.5 THEN 1.0 WHEN least(n1, n2) / CAST(greatest(n1, n2) AS DOUBLE) > 0.3 THEN 0.8 ELSE 0.6 END AS score FROM gp),
    bl AS (SELECT left_id, right_id, min(i1) AS i1, min(i2) AS i2, arg_min(m1, i1) AS m1, arg_min(m2, i2) AS m2, arg_min(a0, i1) AS a0, arg_min(a1, i1) AS a1,
        arg_min(b0, i2) AS b0, arg_min(b1, i2) AS b1, count(DISTINCT i1) AS c1, count(DISTINCT i2) AS c2, count(*) AS n, min(score) AS score,
        min(s_) AS s_, min(q_) AS q_, min(t_) AS t_, min(f_) AS f_, min(o_) AS o_,
        min(array_to_string(list_sort(list_intersect(list_distinct(string_split(ty1, ' ')), list_distinct(string_split(ty2, ' ')))), ',')) AS pat
        FROM gc WHERE score > 0.7 GROUP BY left_id, right_id, ty1, ty2, op1, op2),
    bn AS (SELECT *, row_number() OVER (PARTITION BY left_id, right_id ORDER BY i1, i2) - 1 AS bi FROM bl)"""
COUNTS = "fk AS (SELECT f.file_id, count(fu.name) AS nf FROM f LEFT JOIN fu ON fu.file_id = f.file_id GROUP BY f.file_id)"
SUMMARY = """sm AS (SELECT sp.left_id, sp.right_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_shared_blocks,
        coalesce(sum(n * score) / sum(n), 0.0) AS average_similarity, any_value(k1.nf) AS functions_left, any_value(k2.nf) AS functions_right,
        coalesce(sum(n), 0) / CAST(greatest(any_value(k1.nf), any_value(k2.nf)) AS DOUBLE) * 100 AS shared_percentage
        FROM sp LEFT JOIN bl USING (left_id, right_id) JOIN fk k1 ON k1.file_id = left_id JOIN fk k2 ON k2.file_id = right_id GROUP BY sp.left_id, sp.right_id)"""
MATCHES = """ml AS (SELECT DISTINCT bn.left_id, bn.right_id, bn.bi, fu.file_id, fu.idx, fu.name, bn.score, bn.m1, bn.m2 FROM bn JOIN fu ON fu.file_id = bn.left_id
        AND (fu.name = bn.m1 OR fu.row BETWEEN bn.a0 AND bn.a1)),
    mr AS (SELECT DISTINCT bn.left_id, bn.right_id, bn.bi, fu.file_id, fu.idx, fu.name, bn.score, bn.m1, bn.m2 FROM bn JOIN fu ON fu.file_id = bn.right_id
        AND (fu.name = bn.m2 OR fu.row BETWEEN bn.b0 AND bn.b1))"""
BEST = """bm AS (SELECT left_id, right_id, 'left' AS side, idx, name, max(score) AS score, 'function_' || arg_min(m2, (-score, bi)) AS target FROM ml GROUP BY left_id, right_id, idx, name
    UNION ALL SELECT left_id, right_id, 'right', idx, name, max(score), 'function_' || arg_min(m1, (-score, bi)) FROM mr GROUP BY left_id, right_id, idx, name)"""


def node_id(prefix: str, idx: str, name: str) -> str:
    return f"{prefix} || '_function_' || CAST({idx} AS VARCHAR) || '_' || {name}"


SIM_EDGES = f"""se AS (SELECT bn.left_id, bn.right_id, 'similarity_edge_' || CAST(bn.bi AS VARCHAR) AS id,
        {node_id("'file1'", 'a.idx', 'a.name')} AS source, {node_id("'file2'", 'b.idx', 'b.name')} AS target, 'similarity' AS type, bn.score AS similarity_score
        FROM bn JOIN (SELECT left_id, right_id, bi, min(idx) AS idx, arg_min(name, idx) AS name FROM ml GROUP BY ALL) a USING (left_id, right_id, bi)
        JOIN (SELECT left_id, right_id, bi, min(idx) AS idx, arg_min(name, idx) AS name FROM mr GROUP BY ALL) b USING (left_id, right_id, bi))"""
CALLS = """ca AS (SELECT a.file_id, a.idx AS source_index, a.name AS source_name, b.idx AS target_index, b.name AS target_name, min(l.row) AS line
        FROM fu a JOIN fu b ON a.file_id = b.file_id AND a.idx <> b.idx JOIN fl l ON l.file_id = a.file_id AND l.row BETWEEN a.row AND a.last_row
        AND regexp_matches(l.line, '\\b' || b.name || '\\s*\\(') GROUP BY ALL)"""
SIDES = """sd AS (SELECT left_id, right_id, 'left' AS side, 'file1' AS prefix, left_id AS file_id FROM sp
    UNION ALL SELECT left_id, right_id, 'right', 'file2', right_id FROM sp)"""
EDGES = f"""ce AS (SELECT left_id, right_id, 'call_edge_' || {node_id('prefix', 'source_index', 'source_name')} || '_to_' || {node_id('prefix', 'target_index', 'target_name')} AS id,
        {node_id('prefix', 'source_index', 'source_name')} AS source, {node_id('prefix', 'target_index', 'target_name')} AS target,
        'function_call' AS type, line, CAST(NULL AS DOUBLE) AS similarity_score FROM sd JOIN ca USING (file_id)
        UNION ALL SELECT left_id, right_id, id, source, target, type, NULL, similarity_score FROM se)"""
TOKENISED = [SOURCE, SOURCE_TOKENS, PREPARED]
PAIRED = [*TOKENISED, SOURCE_PAIRS]
BLOCKED = [*PAIRED, FUNCTIONS, SHAPES, BLOCKS]
IMPORTS = """im AS (SELECT file_id, array_to_string(list_distinct_ordered, ',') AS imports, len(list_distinct_ordered) AS n FROM (
        SELECT f.file_id, list(nm ORDER BY o) AS list_distinct_ordered FROM (
            SELECT file_id, nm, min(o) AS o FROM (
                SELECT file_id, trim(string_split(trim(unnest(string_split(clause, ','))), ' as ')[1]) AS nm, ci * 1000 + unnest(range(len(string_split(clause, ',')))) AS o FROM (
                    SELECT file_id, unnest(cl_) AS clause, unnest(range(len(cl_))) AS ci FROM (
                        SELECT file_id, regexp_extract_all(content, '(?m)^(?:from\\s+\\S+\\s+)?import\\s+([^#\\n]+)', 1) AS cl_ FROM f)))
            WHERE nm <> '' GROUP BY file_id, nm) z RIGHT JOIN f USING (file_id) GROUP BY f.file_id))"""

# ---- scalar functions ------------------------------------------------------------------------------

_FILES = ", ".join(f"({q(k)}, {q(v)})" for k, v in languages.FILE_LANGUAGE.items())
_LANG = f"lm(file_key, language) AS (VALUES {_FILES})"
_NAMED = (
    "gn AS (SELECT *, string_split(path, '/')[-1] AS nm, lower(regexp_extract(string_split(path, '/')[-1], '^.+([.][^.]+)$', 1)) AS sfx FROM g)"
)
_HTML = """CASE WHEN contains(lower(content), '<!doctype html') OR contains(lower(content), '<html') THEN 'html' ELSE 'xml' END"""
ORACLES["lang_detect"] = with_(
    PAGES, _LANG, _NAMED,
    body=f"""SELECT file_id, coalesce(a.language, b.language, 'python') AS by_path,
        coalesce(a.language, b.language, {_HTML}) AS by_content, b.language IS NOT NULL AS supported
        FROM gn LEFT JOIN lm a ON a.file_key = nm LEFT JOIN lm b ON b.file_key = sfx""",
)
ORACLES["supported_files"] = with_(
    PAGES, _LANG, _NAMED,
    body="SELECT submission_id, path, octet_length(encode(content)) AS size_bytes FROM gn WHERE sfx IN (SELECT file_key FROM lm)",
)
ORACLES["resolve_root"] = with_(
    PAGES,
    body="""SELECT g.submission_id, CASE WHEN t.n = 1 AND t.folder THEN substr(path, length(t.top) + 2) ELSE path END AS path,
        octet_length(encode(content)) AS size_bytes FROM g JOIN (
        SELECT submission_id, count(DISTINCT string_split(path, '/')[1]) FILTER (NOT starts_with(path, '.')) AS n,
            min(string_split(path, '/')[1]) AS top, bool_or(contains(path, '/')) AS folder FROM g GROUP BY 1) t USING (submission_id)""",
)
_SEG = "string_split(regexp_replace(link, '/+$', ''), '/')"
_GIT = "CASE WHEN ends_with(link, '.git') THEN link ELSE link || '.git' END"
ORACLES["link_classify"] = with_(
    SUBS,
    body=f"""SELECT id, CASE WHEN lower(link) LIKE 's3://%' OR lower(link) LIKE '%.s3.%' OR lower(link) LIKE '%amazonaws.com%' THEN 's3'
            WHEN lower(link) LIKE '%github.com%' THEN 'github' WHEN lower(link) LIKE '%gitlab.com%' OR lower(link) LIKE '%/gitlab%' THEN 'gitlab' END AS link_type,
        CASE WHEN len({_SEG}) >= 2 THEN regexp_replace({_SEG}[-1], '[.]git$', '') ELSE 'repo' END AS repo_name,
        CASE WHEN regexp_matches(link, '^s3://[^/]+/+.') THEN regexp_extract(link, '^s3://([^/]+)', 1) END AS bucket,
        CASE WHEN regexp_matches(link, '^s3://[^/]+/+.') THEN regexp_extract(link, '^s3://[^/]+/+(.+)$', 1) END AS object_key,
        CASE WHEN starts_with(link, 'https://github.com/') THEN CASE WHEN regexp_matches(link, '^https://github[.]com/[^/]*/[^/]*$') THEN {_GIT} END
            WHEN contains(link, '/') AND NOT starts_with(link, 'http') AND NOT starts_with(link, 'git@github.com:')
                THEN CASE WHEN regexp_matches(link, '^[^/]*/[^/]*$') THEN 'https://github.com/' || link || '.git' END END AS github_url,
        CASE WHEN starts_with(link, 'https://gitlab.com/') THEN CASE WHEN regexp_matches(link, '^https://gitlab[.]com/.*/') THEN {_GIT} END
            WHEN starts_with(link, 'git@gitlab.com:') THEN 'https://gitlab.com/' || replace(link, 'git@gitlab.com:', '') || '.git'
            WHEN starts_with(link, 'https://') AND contains(lower(link), 'gitlab') THEN {_GIT} END AS gitlab_url
        FROM s""",
)
_HOSTED = "(lower(link) LIKE '%github.com%' OR lower(link) LIKE '%gitlab.com%')"
ORACLES["validate_submissions"] = with_(
    SUBS,
    f"""e AS (SELECT id, list_filter([
        CASE WHEN link = '' THEN 'emptyLink' END,
        CASE WHEN {_HOSTED} AND NOT starts_with(lower(link), 'https://') THEN 'hostedLinkNotHttps' END,
        CASE WHEN NOT {_HOSTED} AND NOT starts_with(link, 's3://') THEN 'unsupportedLink' END,
        CASE WHEN {_HOSTED} AND (contains(link, '/tree/') OR contains(link, '/blob/')) THEN 'linkNotRepositoryRoot' END,
        CASE WHEN file_size_bytes < 0 THEN 'negativeFileSize' END, CASE WHEN file_size_bytes > 5368709120 THEN 'fileSizeTooLarge' END,
        CASE WHEN file_count < 0 THEN 'negativeFileCount' END, CASE WHEN file_count > 10000 THEN 'tooManyFiles' END
        ], lambda x: x IS NOT NULL) AS errors FROM s)""",
    body="SELECT id, array_to_string(errors, ',') AS errors, len(errors) = 0 AS valid FROM e",
)

# ---- token queries ---------------------------------------------------------------------------------

ORACLES["tokenize_documents"] = with_(
    PROSE, TEXT_TOKENS,
    body="SELECT project, file_id, type, count(*) AS n, count(DISTINCT text) AS texts, max(row) AS last_line FROM tok GROUP BY ALL",
)
ORACLES["tokenize_pages"] = with_(
    PAGES, MARKUP_TOKENS, body="SELECT file_id, type, count(*) AS n, count(DISTINCT text) AS texts FROM tok GROUP BY ALL"
)
ORACLES["tokenize_sources"] = with_(
    SOURCE, SOURCE_TOKENS,
    body="SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY row, k) - 1 AS pos, type, text, row AS start FROM tok",
)
ORACLES["token_profile"] = with_(
    PROSE, TEXT_TOKENS,
    """t AS (SELECT p.project, p.file_id, coalesce(x.n, 0) AS n,
        len(string_split(regexp_replace(content, '\\n$', ''), chr(10))) AS lines
        FROM p LEFT JOIN (SELECT file_id, count(*) AS n FROM tok GROUP BY 1) x USING (file_id))""",
    body="""SELECT project, file_id, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(n) AS BIGINT) AS kept_tokens, CAST(sum(lines) AS BIGINT) AS lines,
        count(*) AS files FROM t GROUP BY GROUPING SETS ((project, file_id), (project))""",
)
ORACLES["decode_text"] = with_(PAGES, body="SELECT file_id, md5(replace(content, '<', chr(10) || '<')) AS text_md5 FROM g")
ORACLES["stored_tokens"] = with_(
    SOURCE, SOURCE_TOKENS, body="SELECT f.file_id, count(tok.type) AS n_tokens FROM f LEFT JOIN tok ON tok.file_id = f.file_id GROUP BY 1"
)
ORACLES["combined_score"] = with_(
    COMPS, body="SELECT id, round_even(jaccard_similarity * 0.4 + type_similarity * 0.3 + structural_similarity * 0.3, 4) AS combined_score FROM c"
)
ORACLES["function_list_fallback"] = with_(
    SOURCE, FUNCTIONS,
    body="""SELECT file_id, idx AS function_index, name AS function_name, row AS start_line, last_row AS end_line FROM fu WHERE language = 'python'""",
)
ORACLES["prepare_similarity"] = with_(
    *TOKENISED,
    body="SELECT type, coalesce(holder, text) AS text, holder IS NOT NULL AS normalized, count(*) AS n FROM pre GROUP BY ALL",
)
ORACLES["signature"] = with_(
    *TOKENISED,
    body="SELECT file_id, string_agg(part, ' | ' ORDER BY row, k) AS signature, len(string_split(string_agg(part, ' | ' ORDER BY row, k), ' | ')) AS parts FROM sig GROUP BY 1",
)
for _name, _seq in {"type_sequence": "types", "structural_sequence": "structural", "flow_sequence": "flow", "operation_sequence": "ops"}.items():
    ORACLES[_name] = with_(*TOKENISED, features("file_id"), body=f"SELECT file_id, {_seq} AS sequence FROM ft")
ORACLES["detokenize"] = with_(
    SOURCE, SOURCE_TOKENS, body="SELECT file_id, string_agg(text, ' ' ORDER BY row, k) AS text FROM tok WHERE text <> '' GROUP BY 1"
)
ORACLES["code_blocks"] = with_(
    PROSE,
    body="""SELECT file_id, CAST(s AS INTEGER) AS start_line, array_to_string(l[s + 1:s + 3], chr(10)) AS block FROM (
        SELECT file_id, l, unnest(range(0, len(l), 3)) AS s FROM (SELECT file_id, string_split(content, chr(10)) AS l FROM p))""",
)
ORACLES["import_extract"] = with_(SOURCE, IMPORTS, body="SELECT file_id, imports FROM im")

# ---- functions -------------------------------------------------------------------------------------

ORACLES["function_list"] = with_(
    SOURCE, FUNCTIONS,
    body="""SELECT file_id, idx AS function_index, name AS function_name, row AS start_line, last_row AS end_line, code AS code_block,
        node AS node_type, language FROM fc""",
)
ORACLES["function_counts"] = with_(
    SOURCE, FUNCTIONS, COUNTS, body="SELECT file_id, language, nf AS function_count FROM fk JOIN f USING (file_id)"
)
_BLOCK = "SELECT file_id, {q} AS tag, unnest(range(len(x))) AS block_index, unnest(x) AS block FROM (SELECT file_id, regexp_extract_all(content, '(?s)<{t}[^>]*>(.*?)</{t}>', 1) AS x FROM g)"
ORACLES["page_blocks"] = with_(PAGES, body=" UNION ALL ".join(_BLOCK.format(t=t, q=q(t)) for t in ("p", "li", "h1")))
ORACLES["call_edges"] = with_(SOURCE, FUNCTIONS, CALLS, body="SELECT * FROM ca")

# ---- pairs -----------------------------------------------------------------------------------------

_NEWEST = "n AS (SELECT project, step, arg_max(id, (upload_time, id)) AS id, arg_max(group_id, (upload_time, id)) AS group_id FROM s GROUP BY 1, 2)"
_CAND = "SELECT s.project, s.step, n.id AS submission_id, s.id AS compared_submission_id FROM n JOIN s USING (project, step) WHERE s.id <> n.id AND "
ORACLES["candidate_pairs"] = with_(SUBS, _NEWEST, body=_CAND + "s.group_id <> n.group_id")
ORACLES["candidate_pairs_completed"] = with_(SUBS, _NEWEST, body=_CAND + "s.status = 'completed'")
ORACLES["candidate_counts"] = with_(
    SUBS,
    body="""SELECT a.project, a.step, count(DISTINCT a.id) AS submissions, count(DISTINCT a.group_id) AS groups,
        count(*) FILTER (a.group_id <> b.group_id) AS other_group_pairs, count(*) FILTER (a.id <> b.id AND b.status = 'completed') AS completed_pairs
        FROM s a JOIN s b USING (project, step) GROUP BY a.project, a.step""",
)
_WAITING = "w AS (SELECT * FROM c WHERE status <> 'completed'), d AS (SELECT * FROM c WHERE status = 'completed')"
_EX = "SELECT submission_id, compared_submission_id, project, step FROM w WHERE NOT EXISTS (SELECT 1 FROM d WHERE "
_SAME = "(d.submission_id = w.submission_id AND d.compared_submission_id = w.compared_submission_id)"
_MIRROR = "(least(d.submission_id, d.compared_submission_id), greatest(d.submission_id, d.compared_submission_id)) = (least(w.submission_id, w.compared_submission_id), greatest(w.submission_id, w.compared_submission_id))"
ORACLES["exclude_existing"] = with_(COMPS, _WAITING, body=_EX + _SAME + ")")
ORACLES["exclude_existing_symmetric"] = with_(COMPS, _WAITING, body=_EX + _MIRROR + ")")
DOCUMENT_PAIRS = f"""pt AS (SELECT DISTINCT project, group_id, file_id, type || ':' || text AS part FROM (
        SELECT * FROM tok WHERE type NOT IN ('integer', 'float'))
        UNION SELECT DISTINCT project, group_id, file_id, '<NUMBER>' FROM tok WHERE type IN ('integer', 'float')),
    ds AS (SELECT project, group_id, file_id, list(part ORDER BY part) AS parts FROM pt GROUP BY ALL),
    dc AS (SELECT project, parts, count(*) AS copies, min(file_id) AS id, {_RANGE} FROM ds GROUP BY ALL),
    dx AS (SELECT project, id, lo, unnest(parts) AS part FROM dc),
    dn AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS common FROM dx a JOIN dx b ON a.project = b.project AND a.part = b.part AND a.lo < b.lo GROUP BY ALL),
    dr AS (SELECT a.project, {_NAMED_PAIR},
        common / CAST(len(a.parts) + len(b.parts) - common AS DOUBLE) AS jaccard_similarity
        FROM dn JOIN dc a ON a.id = a_id JOIN dc b ON b.id = b_id
        WHERE {_NOT_ONE_GROUP} AND common / CAST(len(a.parts) + len(b.parts) - common AS DOUBLE) >= 0.7
        UNION ALL SELECT project, {_OWN_PAIR}, 1.0 FROM dc WHERE len(gs) > 1)"""
ORACLES["document_pairs"] = with_(PROSE, TEXT_TOKENS, DOCUMENT_PAIRS, body="SELECT * FROM dr")
ORACLES["copy_class_members"] = with_(
    PROSE, TEXT_TOKENS, DOCUMENT_PAIRS,
    body="""SELECT p.project, p.file_id, p.group_id, min(p.file_id) OVER w AS class_id, count(*) OVER w AS copies
        FROM p LEFT JOIN ds USING (file_id) WINDOW w AS (PARTITION BY p.project, ds.parts)""",
)
ORACLES["incremental_compare_stream"] = with_(
    PROSE, TEXT_TOKENS, DOCUMENT_PAIRS,
    "st AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS common FROM dx a JOIN dx b ON a.project = b.project AND a.part = b.part GROUP BY ALL)",
    "sj AS (SELECT a_id, b_id, b.copies, common / CAST(len(a.parts) + len(b.parts) - common AS DOUBLE) AS j FROM st JOIN dc a ON a.id = a_id JOIN dc b ON b.id = b_id)",
    body="""SELECT CAST(ds.file_id AS VARCHAR) AS submission_id, CAST(b_id AS VARCHAR) AS compared_submission_id, j AS jaccard_similarity, sj.copies,
        'completed' AS status, ds.project, 'documents' AS step
        FROM ds JOIN dc ON dc.project = ds.project AND dc.parts = ds.parts JOIN sj ON a_id = dc.id WHERE j >= 0.7 AND b_id < ds.file_id""",
)
ORACLES["document_alerts"] = with_(
    PROSE, TEXT_TOKENS, DOCUMENT_PAIRS,
    body="""SELECT dr.*, a.path AS left_path, length(a.content) AS left_size, b.path AS right_path, length(b.content) AS right_size
        FROM dr JOIN p a ON a.file_id = left_id JOIN p b ON b.file_id = right_id""",
)
ORACLES["file_similarity"] = with_(
    *PAIRED, SCORED,
    body=f"""SELECT project, language, left_id, right_id, left_copies, right_copies, left_class, right_class, jaccard_similarity, t_ AS type_similarity,
        round_even(s_, 4) AS structural_similarity, round_even(q_, 4) AS type_sequence_similarity, round_even(f_, 4) AS flow_similarity,
        round_even(o_, 4) AS operation_similarity, round_even(ratio, 4) AS length_ratio, pen AS length_penalty,
        len(list_intersect(list_distinct(p1), list_distinct(p2))) AS common_elements, len(list_distinct(list_concat(p1, p2))) AS total_unique_elements,
        len(p1) AS signature1_length, len(p2) AS signature2_length, n1 AS tokens1_length, n2 AS tokens2_length,
        array_to_string(list_sort(list_intersect(list_distinct(string_split(ty1, ' ')), list_distinct(string_split(ty2, ' ')))), ',') AS common_types,
        {_signature('p1')} AS signature1, {_signature('p2')} AS signature2, round_even({_OVERALL}, 4) AS overall_similarity FROM sf""",
)
ORACLES["smart_file_pairs"] = with_(
    *PAIRED, FUNCTIONS, COUNTS,
    body="""SELECT left_id, right_id, a.language FROM (SELECT left_id, right_id FROM sp) JOIN fk k1 ON k1.file_id = left_id JOIN fk k2 ON k2.file_id = right_id
        JOIN f a ON a.file_id = left_id JOIN f b ON b.file_id = right_id WHERE k1.nf > 0 AND k2.nf > 0 AND a.language = b.language""",
)
_SUBSEQ = ", ".join(
    f"count({c}) AS n_{n}, md5(coalesce(string_agg({c}, ' ' ORDER BY path, row, k) FILTER ({c} IS NOT NULL), '')) AS {n}"
    for n, c in {"types": "type", "structural": "struct_", "flow": "flow_", "ops": "op_"}.items()
)
ORACLES["submission_sequences"] = with_(
    *TOKENISED,
    body=f"""SELECT x.*, t.n_tokens, t.files_count FROM (SELECT submission_id, {_SUBSEQ} FROM sig GROUP BY 1) x
        JOIN (SELECT submission_id, count(*) AS n_tokens, count(DISTINCT file_id) AS files_count FROM tok GROUP BY 1) t USING (submission_id)""",
)
ORACLES["submission_overlap"] = with_(
    *TOKENISED,
    features("project, submission_id, file_id"),
    """ss AS (SELECT project, submission_id, list_distinct(list_filter(flatten(list(parts)), lambda x: trim(x) <> '')) AS ps, count(*) AS n FROM ft GROUP BY 1, 2),
    big AS (SELECT project, arg_max(submission_id, (n, submission_id)) AS submission_id FROM ss GROUP BY 1)""",
    body="""SELECT project, a.submission_id, b.submission_id AS compared_submission_id, len(list_intersect(a.ps, b.ps)) AS common, len(a.ps) AS n1, len(b.ps) AS n2,
        len(list_intersect(a.ps, b.ps)) / CAST(len(a.ps) + len(b.ps) - len(list_intersect(a.ps, b.ps)) AS DOUBLE) AS jaccard_similarity
        FROM big JOIN ss a USING (project, submission_id) JOIN ss b USING (project) WHERE a.submission_id <> b.submission_id""",
)
ORACLES["best_file_pair"] = with_(
    *PAIRED, SCORED,
    body="""SELECT *, jaccard_similarity < 0.5 AS projects_are_different, jaccard_similarity > 0.3 AS are_projects_similar FROM (
        SELECT project, arg_max(left_id, (jaccard_similarity, -left_id, -right_id)) AS left_id, arg_max(right_id, (jaccard_similarity, -left_id, -right_id)) AS right_id,
        max(jaccard_similarity) AS jaccard_similarity, arg_max(t_, (jaccard_similarity, -left_id, -right_id)) AS type_similarity, count(*) AS total_file_pairs FROM sf GROUP BY 1)""",
)
ORACLES["comparison_details"] = with_(
    *PAIRED, SCORED,
    body="""SELECT left_id, right_id, len(list_intersect(list_distinct(p1), list_distinct(p2))) AS common_elements, n1 AS tokens1, n2 AS tokens2, jaccard_similarity FROM sf""",
)

# ---- shared blocks and graph -----------------------------------------------------------------------

ORACLES["shared_blocks"] = with_(
    *BLOCKED,
    body="""SELECT left_id, right_id, m1 AS left_function, i1 AS left_function_index, a0 AS left_start_line, a1 AS left_end_line,
        m2 AS right_function, i2 AS right_function_index, b0 AS right_start_line, b1 AS right_end_line, c1 AS left_functions, c2 AS right_functions,
        n AS function_pairs, score AS similarity_score, s_ AS structural_similarity, q_ AS type_sequence_similarity, t_ AS type_set_similarity,
        f_ AS flow_similarity, o_ AS operation_similarity, pat AS common_patterns FROM bl""",
)
ORACLES["shared_block_code"] = with_(
    *BLOCKED,
    body="""SELECT bl.left_id, bl.right_id, m1 AS left_function, m2 AS right_function, a.language AS left_language, b.language AS right_language,
        a.node AS left_node_type, b.node AS right_node_type, a.code AS left_code_block, b.code AS right_code_block
        FROM bl JOIN fc a ON a.file_id = left_id AND a.idx = i1 JOIN fc b ON b.file_id = right_id AND b.idx = i2""",
)
SUMMED = [*BLOCKED, COUNTS, SUMMARY]
ORACLES["shared_block_summary"] = with_(
    *SUMMED,
    body="SELECT *, total_shared_blocks > 0 AS shared_code_detected, total_shared_blocks > 0 AND average_similarity > 0.8 AS high_quality_shared_code FROM sm",
)
ORACLES["rank_file_pairs"] = with_(*SUMMED, body="SELECT * FROM sm WHERE total_shared_blocks > 0")
ORACLES["multifile_summary"] = with_(
    *SUMMED,
    body="""SELECT a.submission_id AS submission1, b.submission_id AS submission2, CAST(sum(total_shared_blocks) AS BIGINT) AS total_shared_blocks,
        CASE WHEN sum(total_shared_blocks) > 0 THEN sum(total_shared_blocks * average_similarity) / sum(total_shared_blocks) ELSE 0.0 END AS average_similarity,
        CAST(sum(functions_left) AS BIGINT) AS functions_left, CAST(sum(functions_right) AS BIGINT) AS functions_right, count(*) AS file_comparisons,
        count(*) FILTER (total_shared_blocks > 0) AS successful_comparisons, count(*) FILTER (total_shared_blocks > 0) / CAST(count(*) AS DOUBLE) * 100 AS shared_percentage
        FROM sm JOIN f a ON a.file_id = left_id JOIN f b ON b.file_id = right_id GROUP BY 1, 2""",
)
MATCHED = [*BLOCKED, MATCHES]
ORACLES["function_block_matches"] = with_(
    *MATCHED, body="SELECT left_id, right_id, bi AS block_index, file_id, idx AS function_index, name AS function_name FROM ml"
)
ORACLES["best_match"] = with_(
    *MATCHED, BEST,
    body="SELECT left_id, right_id, side, idx AS function_index, name AS function_name, score AS similarity_score, target AS similarity_target FROM bm",
)
ORACLES["similarity_edges"] = with_(*MATCHED, SIM_EDGES, body="SELECT * FROM se")
GRAPHED = [*MATCHED, SIM_EDGES, CALLS, SIDES, EDGES]
ORACLES["graph_edges"] = with_(*GRAPHED, body="SELECT * FROM ce")
ORACLES["graph_summary"] = with_(
    *GRAPHED, COUNTS,
    body="""SELECT sp.left_id, sp.right_id, count(se.id) AS total_similarities, coalesce(sum(se.similarity_score), 0.0) / greatest(count(se.id), 1) AS average_similarity,
        count(se.id) > 0 AS has_similarity, any_value(k1.nf) AS functions_left, any_value(k2.nf) AS functions_right
        FROM sp LEFT JOIN se USING (left_id, right_id) JOIN fk k1 ON k1.file_id = left_id JOIN fk k2 ON k2.file_id = right_id GROUP BY sp.left_id, sp.right_id""",
)
_PAIR_NAME = "'pair_' || CAST(left_id AS VARCHAR) || '_' || CAST(right_id AS VARCHAR)"
ORACLES["combined_graph"] = with_(
    *GRAPHED,
    body=f"""SELECT {_PAIR_NAME} || '_' || id AS id, {_PAIR_NAME} || '_' || source AS source, {_PAIR_NAME} || '_' || target AS target, type, line, similarity_score,
        {_PAIR_NAME} AS pair FROM ce WHERE (left_id, right_id) IN (SELECT (left_id, right_id) FROM se)""",
)
_NODES = f"""SELECT left_id, right_id, prefix || '_root' AS id, 'file_subflow' AS type, '📁 ' || string_split(f.path, '/')[-1] AS label, NULL AS parent,
            fk.nf AS functions_count, im.n AS imports_count, CAST(NULL AS DOUBLE) AS similarity_score, NULL AS similarity_target
            FROM sd JOIN f USING (file_id) JOIN fk USING (file_id) JOIN im USING (file_id)
        UNION ALL SELECT left_id, right_id, prefix || '_imports_group', 'import_group', '📦 Imports (' || CAST(im.n AS VARCHAR) || ')', prefix || '_root', fk.nf, im.n, NULL, NULL
            FROM sd JOIN fk USING (file_id) JOIN im USING (file_id) WHERE im.n > 0
        UNION ALL SELECT sd.left_id, sd.right_id, {node_id('prefix', 'fu.idx', 'fu.name')}, 'function',
            CASE WHEN bm.score IS NULL THEN '⚙️ ' || fu.name ELSE '⚡ ' || fu.name || ' (' || format('{{:.1f}}', bm.score * 100) || '%)' END,
            prefix || '_root', NULL, NULL, coalesce(bm.score, 0.0), bm.target
            FROM sd JOIN fu USING (file_id) LEFT JOIN bm ON bm.left_id = sd.left_id AND bm.right_id = sd.right_id AND bm.side = sd.side AND bm.idx = fu.idx"""
ORACLES["graph_nodes"] = with_(*MATCHED, BEST, SIDES, COUNTS, IMPORTS, body=_NODES)
ORACLES["combined_graph_nodes"] = with_(
    *GRAPHED, BEST, COUNTS, IMPORTS,
    body=f"""SELECT {_PAIR_NAME} || '_' || id AS id, type, label, CASE WHEN parent IS NOT NULL THEN {_PAIR_NAME} || '_' || parent END AS parent,
        functions_count, imports_count, similarity_score, similarity_target, {_PAIR_NAME} AS pair
        FROM ({_NODES}) n WHERE (left_id, right_id) IN (SELECT (left_id, right_id) FROM se)""",
)

# ---- reports ---------------------------------------------------------------------------------------

_STATS = """st AS (SELECT project, step, count(*) AS total_comparisons, count(*) FILTER (overall_similarity >= 0.7) AS high_similarity_pairs,
        round_even(avg(overall_similarity), 3) AS average_similarity, round_even(max(overall_similarity), 3) AS max_similarity FROM c GROUP BY 1, 2)"""
ORACLES["similarity_statistics"] = with_(
    COMPS, _STATS,
    body="""SELECT st.*, b.status_breakdown FROM st JOIN (SELECT project, step, string_agg(status || '=' || CAST(n AS VARCHAR), ',' ORDER BY status) AS status_breakdown
        FROM (SELECT project, step, status, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1, 2) b USING (project, step)""",
)
_BOTH = "JOIN s a ON a.id = c.submission_id JOIN s b ON b.id = c.compared_submission_id"
ORACLES["similarity_alerts"] = with_(
    SUBS, COMPS,
    body=f"""SELECT c.id AS similarity_id, c.project, c.step, overall_similarity, shared_blocks_count, created_at AS detected_at, a.id AS submission1, a.link AS link1,
        b.id AS submission2, b.upload_time AS upload2 FROM c {_BOTH} WHERE overall_similarity >= 0.7""",
)
ORACLES["similarity_overview"] = with_(
    SUBS, COMPS, _STATS,
    f"al AS (SELECT c.*, row_number() OVER (PARTITION BY c.project, c.step ORDER BY overall_similarity DESC, c.id) AS rk FROM c {_BOTH} WHERE overall_similarity >= 0.7)",
    "ag AS (SELECT project, step, count(*) AS n, string_agg(id, ',' ORDER BY rk) FILTER (rk <= 10) AS alerts FROM al GROUP BY 1, 2)",
    body="""SELECT project, step, total_comparisons, high_similarity_pairs, coalesce(n, 0) AS total_flagged_pairs, coalesce(n, 0) > 0 AS review_required,
        CASE WHEN n > 5 THEN 'high' WHEN n > 0 THEN 'medium' ELSE 'low' END AS investigation_priority, alerts FROM st LEFT JOIN ag USING (project, step)""",
)
_SEEN = """se AS (SELECT *, false AS is_swapped, submission_id AS main, compared_submission_id AS other FROM c WHERE submission_id <> compared_submission_id
    UNION ALL SELECT *, true, compared_submission_id, submission_id FROM c)"""
ORACLES["bidirectional_similarities"] = with_(
    SUBS, COMPS, _SEEN,
    body="""SELECT se.id AS similarity_id, main AS submission_id, other AS compared_submission_id, s.link AS compared_submission_link, is_swapped, overall_similarity,
        se.status FROM se LEFT JOIN s ON s.id = other""",
)
ORACLES["similarity_totals"] = with_(
    COMPS, _SEEN,
    body="SELECT main AS submission_id, count(*) AS total_comparisons, count(*) FILTER (overall_similarity >= 0.7) AS high_similarity_count FROM se GROUP BY 1",
)
ORACLES["detailed_comparison"] = with_(
    SUBS, COMPS,
    body=f"SELECT c.id AS similarity_id, a.link AS link1, b.link AS link2, overall_similarity, flow_similarity, c.status FROM c {_BOTH}",
)
_LT = """CASE WHEN lower(link) LIKE 's3://%' THEN 's3' WHEN lower(link) LIKE '%github.com%' THEN 'github'
    WHEN lower(link) LIKE '%gitlab.com%' OR lower(link) LIKE '%/gitlab%' THEN 'gitlab' ELSE 'unknown' END"""


def _breakdown(column: str, expression: str) -> str:
    return f"""(SELECT project, group_id, string_agg(k || '=' || CAST(n AS VARCHAR), ',' ORDER BY k) AS {column}_breakdown FROM (
        SELECT project, group_id, {expression} AS k, count(*) AS n FROM s GROUP BY ALL) GROUP BY 1, 2)"""


ORACLES["submission_statistics"] = with_(
    SUBS,
    body=f"""SELECT * FROM (SELECT project, group_id, count(*) AS total_submissions, max(upload_time) AS latest_submission FROM s GROUP BY 1, 2)
        JOIN {_breakdown('status', 'status')} USING (project, group_id) JOIN {_breakdown('step', 'step')} USING (project, group_id)
        JOIN {_breakdown('link_type', _LT)} USING (project, group_id)""",
)
ORACLES["dedupe_submissions"] = with_(
    SUBS,
    body="""SELECT id, project, group_id, step, upload_time FROM s QUALIFY row_number() OVER (PARTITION BY project, group_id, step ORDER BY upload_time, id) = 1""",
)
ORACLES["list_page"] = with_(SUBS, body="SELECT id, upload_time, link FROM s ORDER BY upload_time DESC, id LIMIT 5000 OFFSET 100")
ORACLES["lookup_step"] = with_(
    SUBS, body="SELECT id, group_id, status, upload_time FROM s WHERE project = 'p1996' AND step = '1-URGENT'"
)
ORACLES["lookup_group"] = with_(SUBS, body="SELECT id, step, status, upload_time FROM s WHERE project = 'p1996' AND group_id = '257'")
ORACLES["lookup_first_of_step"] = with_(
    SUBS,
    body="""SELECT project, group_id, step, id, upload_time, status FROM s
        QUALIFY row_number() OVER (PARTITION BY project, group_id, step ORDER BY upload_time, id) = 1""",
)
ORACLES["lookup_id"] = with_(SUBS, body="SELECT id, project, step, group_id FROM s WHERE id = '7'")
ORACLES["lookup_pair"] = with_(COMPS, body="SELECT id, overall_similarity, status FROM c WHERE submission_id = '7' AND compared_submission_id = '491'")
ORACLES["lookup_comparisons_of_step"] = with_(
    COMPS, body="SELECT id, submission_id, compared_submission_id, overall_similarity FROM c WHERE project = 'p1996' AND step = 'NO'"
)
ORACLES["upsert_submissions"] = with_(
    SUBS,
    "u AS (SELECT CAST(l_orderkey AS VARCHAR) AS id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'rejected' END AS status, count(*) AS file_count FROM lineitem GROUP BY 1)",
    body="""SELECT coalesce(s.id, u.id) AS id, project, coalesce(u.status, s.status) AS status, coalesce(u.file_count, s.file_count) AS file_count, link,
        CASE WHEN u.id IS NOT NULL THEN TIMESTAMP '2020-01-01 00:00:00' END AS updated_at FROM s FULL JOIN u ON s.id = u.id""",
)
ORACLES["upsert_results"] = with_(
    COMPS,
    body="""SELECT id, CASE WHEN status = 'pending' THEN 'completed' ELSE status END AS status,
        CASE WHEN status = 'pending' THEN type_similarity ELSE overall_similarity END AS overall_similarity,
        CASE WHEN status = 'pending' THEN 0.0 ELSE jaccard_similarity END AS jaccard_similarity,
        CASE WHEN status = 'pending' THEN 0.0 ELSE flow_similarity END AS flow_similarity FROM c""",
)
ORACLES["cascade_delete"] = with_(
    SUBS, COMPS, "x AS (SELECT id FROM s WHERE step = '5-LOW')",
    body="""SELECT 'submission' AS kind, id FROM s WHERE id NOT IN (SELECT id FROM x) UNION ALL
        SELECT 'comparison', id FROM c WHERE submission_id NOT IN (SELECT id FROM x) AND compared_submission_id NOT IN (SELECT id FROM x)""",
)
ORACLES["files_count"] = with_(SOURCE, body="SELECT submission_id, count(*) AS files_count FROM f GROUP BY 1")

# ---- rules -----------------------------------------------------------------------------------------

SITES = "hs AS (SELECT DISTINCT submission_id FROM g)"
ENTRIES = """en AS (SELECT submission_id, path, false AS is_dir FROM g UNION ALL
    SELECT submission_id, array_to_string(sg[1:k], '/'), true FROM (
        SELECT submission_id, sg, unnest(range(1, len(sg))) AS k FROM (SELECT submission_id, string_split(path, '/') AS sg FROM g))),
    di AS (SELECT DISTINCT submission_id, path AS directory FROM en WHERE is_dir)"""


def _has(regex: str) -> str:
    return f"bool_or(regexp_matches(path, {q(regex)}))"


def _list(pairs: list[tuple[str, str]]) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(t)} END" for t, c in pairs) + "], lambda x: x IS NOT NULL), ',')"


_MUST = [("*/*.html", "^[^/]*/[^/]*[.]html$"), ("en/*", "^en/[^/]*$"), ("**/index.html", "^(.*/)?index[.]html$")]
_NEVER = [("**/9*", "^(.*/)?9[^/]*$"), ("de/?", "^de/[^/]$"), ("[ef][rs]/*", "^[ef][rs]/[^/]*$")]
PRESENCE = f"""pr AS (SELECT submission_id, {_list([(g, f'NOT {_has(r)}') for g, r in _MUST])} AS missing_files,
    {_list([(g, _has(r)) for g, r in _NEVER])} AS forbidden_files FROM en GROUP BY 1),
    pj AS (SELECT *, CAST(missing_files <> '' AS INT) + CAST(forbidden_files <> '' AS INT) AS e FROM pr)"""
ORACLES["rule_file_presence"] = with_(
    PAGES, ENTRIES, PRESENCE,
    body="""SELECT submission_id, missing_files, forbidden_files, e = 0 AS passed, CASE WHEN e > 0 THEN 'fileValidationFailed' END AS code,
        CASE WHEN e = 0 THEN 'files as asked for' ELSE CAST(e AS VARCHAR) || ' kind(s) of file fault: something missing or not allowed' END AS message FROM pj""",
)
SIZES = """sz AS (SELECT submission_id, CAST(sum(octet_length(encode(content))) AS BIGINT) AS actual_size_bytes, count(*) AS file_count FROM g GROUP BY 1),
    sy AS (SELECT *, actual_size_bytes / 1048576.0 AS mb FROM sz)"""
ORACLES["rule_archive_size"] = with_(
    PAGES, SIZES,
    body="""SELECT submission_id, actual_size_bytes, file_count, round_even(mb, 2) AS actual_size_mb, CASE WHEN mb > 0.05 THEN round_even(mb - 0.05, 2) END AS excess_mb,
        mb <= 0.05 AS passed, CASE WHEN mb > 0.05 THEN 'repositorySizeExceeded' END AS code FROM sy""",
)
VIOLATIONS = """vi AS (SELECT submission_id, 'forbiddenDirectoriesFound' AS code, directory FROM di
        WHERE list_contains(string_split(directory, '/'), 'es') OR (starts_with(directory, 'd') AND ends_with(directory, 'e'))
    UNION ALL SELECT submission_id, 'directoryDepthExceeded', directory FROM di WHERE len(string_split(directory, '/')) > 1)"""
ORACLES["rule_directory_violations"] = with_(PAGES, ENTRIES, VIOLATIONS, body="SELECT * FROM vi")
_NM = "string_split(path, '/')[-1]"
STRUCTURE = f"""ds_ AS (SELECT submission_id, {_list([
        ('en', f"NOT bool_or({_NM} = 'en')"), ('fr/*', 'false'), ('blog', f"NOT bool_or({_NM} = 'blog')")])} AS missing_directories FROM en GROUP BY 1),
    dv AS (SELECT ds_.*, count(*) FILTER (code = 'forbiddenDirectoriesFound') AS v1, count(*) FILTER (code = 'directoryDepthExceeded') AS v2 FROM ds_ LEFT JOIN vi USING (submission_id) GROUP BY ALL),
    dt AS (SELECT dv.*, t.n, CAST(missing_directories <> '' AS INT) + CAST(v1 > 0 AS INT) + CAST(v2 > 0 AS INT) AS e FROM dv
        LEFT JOIN (SELECT submission_id, count(*) AS n FROM di GROUP BY 1) t USING (submission_id))"""
ORACLES["rule_directory_structure"] = with_(
    PAGES, ENTRIES, VIOLATIONS, STRUCTURE,
    body="""SELECT submission_id, missing_directories, v1 AS "forbiddenDirectoriesFound", v2 AS "directoryDepthExceeded", CAST(0 AS BIGINT) AS "emptyDirectoriesFound",
        coalesce(n, 0) AS total_directories, e = 0 AS passed, CASE WHEN e > 0 THEN 'directoryStructureValidationFailed' END AS code,
        CASE WHEN e = 0 THEN CAST(coalesce(n, 0) AS VARCHAR) || ' directories, all as asked for'
            ELSE CAST(e AS VARCHAR) || ' kind(s) of directory fault' END AS message FROM dt""",
)
_CHECKS = [
    ("^en/[^/]*$", "contains(lower(content), 'the ')"),
    ("^(.*/)?[^/]*[.]html$", "regexp_matches(content, '<h1>[A-Z][a-z]+')"),
    ("^[^/][^/]/[^/]*$", "regexp_matches(content, '(?is)^<!doctype html>.*</html>$')"),
]
CONTENT = "cv AS (" + " UNION ALL ".join(
    f"SELECT submission_id, {i} AS check_index, path, NOT ({ok}) AS failed FROM g WHERE regexp_matches(path, {q(p)})" for i, (p, ok) in enumerate(_CHECKS)
) + """), ck AS (SELECT hs.submission_id, i AS check_index, count(cv.path) AS files, count(*) FILTER (cv.failed) AS failed FROM hs CROSS JOIN range(3) r(i)
        LEFT JOIN cv ON cv.submission_id = hs.submission_id AND cv.check_index = i GROUP BY 1, 2),
    cr AS (SELECT submission_id, string_agg(CAST(files AS VARCHAR) || ':' || CAST(failed AS VARCHAR) || ':' ||
        CASE WHEN files = 0 THEN 'noMatchingFiles' WHEN failed > 0 THEN 'contentCheckFailed' ELSE 'ok' END, ',' ORDER BY check_index) AS checks,
        count(*) FILTER (files = 0 OR failed > 0) AS e FROM ck GROUP BY 1)"""  # fmt: skip
ORACLES["rule_content_violations"] = with_(PAGES, SITES, CONTENT, body="SELECT submission_id, check_index, path FROM cv WHERE failed")
ORACLES["rule_file_content"] = with_(
    PAGES, SITES, CONTENT,
    body="""SELECT submission_id, checks, e = 0 AS passed, CASE WHEN e > 0 THEN 'fileContentValidationFailed' END AS code,
        CASE WHEN e = 0 THEN 'contents pass all 3 checks' ELSE CAST(e AS VARCHAR) || ' content check(s) not passed' END AS message FROM cr""",
)
ORACLES["rule_report"] = with_(
    PAGES, SITES, ENTRIES, PRESENCE, SIZES, VIOLATIONS, STRUCTURE, CONTENT,
    """al AS (SELECT submission_id, 0 AS o, e > 0 AS bad, 'file_presence:fileValidationFailed' AS t FROM pj
        UNION ALL SELECT submission_id, 1, mb > 0.05, 'max_archive_size:repositorySizeExceeded' FROM sy
        UNION ALL SELECT submission_id, 2, e > 0, 'directory_structure:directoryStructureValidationFailed' FROM dt
        UNION ALL SELECT submission_id, 3, e > 0, 'file_content:fileContentValidationFailed' FROM cr)""",
    body="""SELECT submission_id, count(*) FILTER (bad) AS failed_rule_count, count(*) AS total_rule_count, count(*) FILTER (bad) = 0 AS passed,
        coalesce(string_agg(t, ',' ORDER BY o) FILTER (bad), '') AS errors FROM al GROUP BY 1""",
)

_FAULTS_A = [(f"missing:{g}", f"NOT {_has(r)}") for g, r in _MUST] + [(f"forbidden:{g}", _has(r)) for g, r in _NEVER]
_FAULTS_B = [("missing:*/*", f"NOT {_has('^[^/]*/[^/]*$')}"), ("missing:fr/**", f"NOT {_has('^fr/.*$')}"), ("forbidden:de/?", _has("^de/[^/]$"))]
_ROOM = "length(submission_id) % 3"
SITE_LISTS = f"""dd AS (SELECT submission_id, _list_a.missing, count(directory) FILTER (list_contains(string_split(directory, '/'), 'es') OR (starts_with(directory, 'd') AND ends_with(directory, 'e'))) AS never,
        count(directory) FILTER (len(string_split(directory, '/')) > 1) AS deep1, count(directory) FILTER (len(string_split(directory, '/')) > 2) AS deep2
        FROM (SELECT submission_id, CASE WHEN {_ROOM} = 0 THEN {_list([
            ('missing:en', f"NOT bool_or({_NM} = 'en')"), ('missing:fr/*', 'false'), ('missing:blog', f"NOT bool_or({_NM} = 'blog')")])}
            ELSE {_list([('missing:en', f"NOT bool_or({_NM} = 'en')"), ('missing:fr', f"NOT bool_or({_NM} = 'fr')")])} END AS missing FROM en GROUP BY 1) _list_a
        LEFT JOIN di USING (submission_id) GROUP BY ALL),
    ch AS (SELECT submission_id, CASE WHEN {_ROOM} = 0 THEN check_index ELSE 1 - check_index END AS i, files, failed FROM ck
        WHERE {_ROOM} = 0 OR ({_ROOM} = 1 AND check_index < 2)),
    cf AS (SELECT submission_id, coalesce(string_agg(CAST(i AS VARCHAR) || CASE WHEN files = 0 THEN ':noMatchingFiles' ELSE ':contentCheckFailed:' || CAST(failed AS VARCHAR) END, ',' ORDER BY i)
        FILTER (files = 0 OR failed > 0), '') AS faults FROM ch GROUP BY 1),
    rt AS (SELECT submission_id, 0 AS ord, 'file_presence' AS name, {_list(_FAULTS_A)} AS faults, 'fileValidationFailed' AS code FROM en WHERE {_ROOM} = 0 GROUP BY 1
        UNION ALL SELECT submission_id, 1, 'max_archive_size', CASE WHEN mb > 0.05 THEN 'bytes:' || CAST(actual_size_bytes AS VARCHAR) ELSE '' END, 'repositorySizeExceeded' FROM sy WHERE {_ROOM} = 0
        UNION ALL SELECT submission_id, 2, 'directory_structure', array_to_string(list_filter([nullif(missing, ''), CASE WHEN never > 0 AND {_ROOM} = 0 THEN 'forbidden:' || CAST(never AS VARCHAR) END,
            CASE WHEN {_ROOM} = 0 AND deep1 > 0 THEN 'deep:' || CAST(deep1 AS VARCHAR) WHEN {_ROOM} = 1 AND deep2 > 0 THEN 'deep:' || CAST(deep2 AS VARCHAR) END], lambda x: x IS NOT NULL), ','),
            'directoryStructureValidationFailed' FROM dd WHERE {_ROOM} < 2
        UNION ALL SELECT submission_id, CASE WHEN {_ROOM} = 0 THEN 3 ELSE 0 END, 'file_content', faults, 'fileContentValidationFailed' FROM cf
        UNION ALL SELECT submission_id, 1, 'file_presence', {_list(_FAULTS_B)}, 'fileValidationFailed' FROM en WHERE {_ROOM} = 1 GROUP BY 1
        UNION ALL SELECT submission_id, 0, 'max_archive_size', 'max_size_mb', 'invalidParameterValue' FROM hs WHERE {_ROOM} = 2
        UNION ALL SELECT submission_id, 1, 'file_presence', 'must_exist', 'invalidParameterType' FROM hs WHERE {_ROOM} = 2
        UNION ALL SELECT submission_id, 2, 'file_content', 'check 0', 'invalidRegexPattern' FROM hs WHERE {_ROOM} = 2
        UNION ALL SELECT submission_id, 3, 'max_archive_size', CASE WHEN mb > 0.01 THEN 'bytes:' || CAST(actual_size_bytes AS VARCHAR) ELSE '' END, 'repositorySizeExceeded' FROM sy WHERE {_ROOM} = 2
        UNION ALL SELECT submission_id, 4, 'nope', 'name', 'unknownRule' FROM hs WHERE {_ROOM} = 2 AND ends_with(submission_id, '.com'))"""
ORACLES["rule_table_results"] = with_(
    PAGES, SITES, ENTRIES, SIZES, CONTENT, SITE_LISTS,
    body="SELECT submission_id, ord, name, faults = '' AS passed, CASE WHEN faults <> '' THEN code END AS code, faults FROM rt",
)
ORACLES["rule_table_report"] = with_(
    PAGES, SITES, ENTRIES, SIZES, CONTENT, SITE_LISTS,
    body="""SELECT submission_id, count(*) FILTER (faults <> '') AS failed_rule_count, count(*) AS total_rule_count,
        coalesce(string_agg(CAST(ord AS VARCHAR) || ':' || name || ':' || code, ',' ORDER BY ord) FILTER (faults <> ''), '') AS errors,
        count(*) FILTER (faults <> '') = 0 AS passed,
        count(*) FILTER (faults <> '') = 0 OR (starts_with(submission_id, 'blog') AND count(*) FILTER (code = 'unknownRule') = 0) AS accepted FROM rt GROUP BY 1""",
)
_CLASS_OF = [*TOKENISED, features("project, language, submission_id, group_id, file_id", name="fc")]
_CLASS_WINDOW = "WINDOW w AS (PARTITION BY project, language, parts, types, ops)"
ORACLES["source_class_members"] = with_(
    *_CLASS_OF,
    body=f"SELECT project, language, file_id, group_id, submission_id, min(file_id) OVER w AS class_id, count(*) OVER w AS copies FROM fc {_CLASS_WINDOW}",
)
ORACLES["submission_class_members"] = with_(
    *TOKENISED,
    features("project, submission_id, file_id"),
    f"""ss AS (SELECT project, submission_id, list_sort(list_distinct(list_filter(flatten(list(parts)), lambda x: trim(x) <> ''))) AS ps FROM ft GROUP BY 1, 2),
    xs AS (SELECT submission_id, {_SUBSEQ} FROM sig GROUP BY 1),
    ts AS (SELECT submission_id, count(*) AS n_tokens, count(DISTINCT file_id) AS files_count FROM tok GROUP BY 1)""",
    body="""SELECT project, submission_id, min(submission_id) OVER w AS class_id, count(*) OVER w AS copies FROM ss JOIN xs USING (submission_id) JOIN ts USING (submission_id)
        WINDOW w AS (PARTITION BY project, ps, types, structural, flow, ops, n_tokens, files_count)""",
)
ORACLES["class_block_summary"] = with_(
    *SUMMED,
    features("project, language, submission_id, group_id, file_id", name="fx"),
    f"""mc AS (SELECT *, min(file_id) OVER w AS class_id FROM fx {_CLASS_WINDOW}),
    nc AS (SELECT class_id, count(DISTINCT file_id) AS files, count(DISTINCT submission_id) AS submissions, count(DISTINCT group_id) AS groups FROM mc GROUP BY 1)""",
    body="""SELECT sm.*, left_class, right_class, a.files AS left_files, a.submissions AS left_submissions, a.groups AS left_groups,
        b.files AS right_files, b.submissions AS right_submissions, b.groups AS right_groups
        FROM sm JOIN sp USING (left_id, right_id) JOIN nc a ON a.class_id = left_class JOIN nc b ON b.class_id = right_class""",
)
_JACCARD = "len(list_intersect(a.ps, b.ps)) / CAST(len(a.ps) + len(b.ps) - len(list_intersect(a.ps, b.ps)) AS DOUBLE)"
ORACLES["similar_submissions"] = with_(
    *TOKENISED,
    features("project, submission_id, file_id"),
    f"""ss AS (SELECT project, submission_id, list_sort(list_distinct(list_filter(flatten(list(parts)), lambda x: trim(x) <> ''))) AS ps FROM ft GROUP BY 1, 2),
    xs AS (SELECT submission_id, {_SUBSEQ} FROM sig GROUP BY 1),
    ts AS (SELECT submission_id, count(*) AS n_tokens, count(DISTINCT file_id) AS files_count FROM tok GROUP BY 1),
    cl AS (SELECT project, ps, min(submission_id) AS id, max(submission_id) AS hi, count(*) AS copies FROM ss JOIN xs USING (submission_id) JOIN ts USING (submission_id)
        WHERE len(ps) > 0 GROUP BY project, ps, types, structural, flow, ops, n_tokens, files_count)""",
    body=f"""SELECT a.project, a.id AS submission_id, b.id AS compared_submission_id, a.copies AS left_copies, b.copies AS right_copies, a.id AS left_class, b.id AS right_class,
        len(list_intersect(a.ps, b.ps)) AS common, len(a.ps) AS n1, len(b.ps) AS n2, {_JACCARD} AS jaccard_similarity
        FROM cl a JOIN cl b ON a.project = b.project AND a.id < b.id WHERE {_JACCARD} >= 0.8
        UNION ALL SELECT project, id, hi, copies, copies, id, id, len(ps), len(ps), len(ps), 1.0 FROM cl WHERE copies > 1""",
)
