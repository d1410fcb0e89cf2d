"""Queries over the identities of calls and what results show, and their SQL forms."""

from __future__ import annotations

from ..functions import commands as C
from ..functions import text as T
from ..operators import events as E
from ..operators import identities as I
from ..sources import table
from .sessions import _BASE, _SPLIT


def _events(f):  # type: ignore[no-untyped-def]
    return lambda spark, d: f(E.tool_events(table(spark, d, "stress_turns")))


QUERIES = {
    "shell_commands": _events(I.commands),
    "event_identities": _events(I.identities),
    "result_predicates": _events(I.results),
    "protected_reads": _events(I.protected),
    "tool_call_labels": _events(I.labels),
    "causal_failures": _events(I.causal_failures),
    "history_rewrite_skips": lambda spark, d: I.rewrite_skips(table(spark, d, "stress_turns")),
    "repeat_trackers": _events(I.trackers),
}


def q(text: str) -> str:
    """A text as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"


def _squeezed(c: str) -> str:
    return f"nullif(trim(regexp_replace({c}, '\\s+', ' ', 'g')), '')"


def _words(c: str) -> str:
    c = _squeezed(c)
    for w in C.WRAPPERS:
        c = f"regexp_replace({c}, {q(w)}, '')"
    return f"list_transform(regexp_extract_all({c}, {q(C.PARTS)}, 1), lambda w: regexp_replace(w, {q(chr(94) + '\"(.*)\"$|^' + chr(39) + '(.*)' + chr(39) + '$')}, '\\1\\2'))"


def _norm(p: str) -> str:
    p = f"regexp_replace(regexp_replace(replace(trim({p}), '\\', '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g')"
    for _ in range(3):
        p = f"regexp_replace({p}, '[^/]+/\\.\\./', '', 'g')"
    return f"regexp_replace({p}, '(.)/$', '\\1')"


def _args(without: tuple[str, ...] = ()) -> str:
    keep = f"e.key NOT IN ({', '.join(map(q, without))})" if without else "true"
    return f"coalesce(array_to_string(list_transform(list_filter(list_sort(map_entries(args)), lambda e: {keep} AND coalesce({_squeezed('e.value')}, '') <> ''), lambda e: e.key || '=' || {_squeezed('e.value')}), ';'), '')"


_SHELL = """
forms AS (SELECT *, coalesce(command, CASE WHEN family = 'file_read' THEN CASE (turn + pos) % 6 WHEN 0 THEN 'cat ' || path WHEN 1 THEN 'head -n 20 ' || path WHEN 2 THEN 'sed -n 1,5p ' || path WHEN 3 THEN 'git show HEAD~1:' || path WHEN 4 THEN 'ls -la ' || path ELSE 'env A=1 uv run wc -l ' || path END
  WHEN family = 'edit' THEN CASE WHEN (turn + pos) % 6 < 3 THEN 'git diff HEAD -- ' || path ELSE 'git log --name-only ' || path END WHEN family = 'search' THEN 'grep -rn "' || query || '" ' || coalesce(path, './src/') END) AS shell FROM x),
"""


def _parsed(source: str, column: str, name: str) -> str:
    """CTEs that read the commands of a column."""
    lists = lambda a: "list_contains([" + ", ".join(map(q, a)) + "], {})"
    return f"""
{name}0 AS (SELECT *, {_words(column)} AS w, regexp_matches({column}, {q(C.UNSAFE)}) AS unsafe, {_squeezed(column)} AS sq FROM {source}),
{name}1 AS (SELECT *, lower(regexp_extract(w[1], '([^/]*)$', 1)) AS root, list_slice(w, 2, len(w)) AS ar FROM {name}0),
{name}2 AS (SELECT *, list_filter(ar, lambda v: NOT starts_with(v, '-')) AS pa, list_filter(ar, lambda v: v <> '--') AS ba FROM {name}1),
{name} AS (SELECT *, CASE WHEN NOT unsafe THEN CASE WHEN root = 'cat' AND len(ba) = 1 AND NOT starts_with(ba[1], '-') THEN ba[1] WHEN root IN ('head', 'tail', 'nl') AND len(pa) = 1 THEN pa[1] WHEN root IN ('head', 'tail', 'nl') AND len(pa) = 2 AND ar[1] = '-n' THEN pa[2]
    WHEN root = 'sed' AND len(ar) = 3 AND ar[1] = '-n' THEN ar[3] END END AS r_path,
  CASE WHEN root IN ('grep', 'rg', 'ag') AND len(pa) > 0 THEN pa[1] END AS s_query, CASE WHEN root IN ('grep', 'rg', 'ag') AND len(pa) > 1 THEN {_norm('pa[-1]')} END AS s_scope,
  CASE WHEN regexp_matches(sq, '^git show ([^:]+):(.+)$') THEN {_norm("regexp_extract(sq, '^git show ([^:]+):(.+)$', 2)")} WHEN regexp_matches(sq, '^git diff (\\S+) ?-- ?(.+)$') THEN {_norm("regexp_extract(sq, '^git diff (\\S+) ?-- ?(.+)$', 2)")} END AS h_path,
  CASE WHEN regexp_matches(sq, '^git show ([^:]+):(.+)$') THEN regexp_extract(sq, '^git show ([^:]+):(.+)$', 1) WHEN regexp_matches(sq, '^git diff (\\S+) ?-- ?(.+)$') THEN regexp_extract(sq, '^git diff (\\S+) ?-- ?(.+)$', 1) END AS rev,
  CASE WHEN NOT unsafe THEN CASE WHEN root = 'git' THEN CASE WHEN lower(w[2]) IN ('log', 'status', 'shortlog', 'blame') THEN 'git_' || lower(w[2]) END WHEN root IN ('stat', 'wc', 'file', 'ls', 'find') THEN root END END AS prb,
  CASE WHEN root IN ('ls', 'find') THEN {_norm("coalesce(list_filter(pa, lambda v: v <> '--')[1], '')")} END AS d_path, CASE WHEN root IN ('ls', 'find') THEN array_to_string(list_filter(ba, lambda v: starts_with(v, '-')), ' ') END AS d_mode,
  CASE WHEN NOT unsafe AND {lists(C.KEPT).format('root')} AND CASE root WHEN 'git' THEN coalesce(lower(w[2]) IN ('status', 'log', 'show', 'diff', 'blame'), false) WHEN 'ruff' THEN lower(w[2]) = 'check' AND NOT list_contains(w, '--fix') WHEN 'sed' THEN list_contains(w, '-n') AND NOT list_contains(w, '-i') AND NOT list_contains(w, '--in-place')
    WHEN 'find' THEN NOT list_has_any(w, ['-delete', '-exec', '-execdir', '-ok', '-okdir']) ELSE true END THEN array_to_string(w, ' ') END AS kept,
  root = 'git' AND coalesce(w[2] IN ('diff', 'log', 'show'), false) AND len(list_filter(w, lambda v: regexp_matches(v, '^(--name-only(=.*)?|--name-status|--raw)$'))) > 0 AS lp FROM {name}2)
"""


_REV = "CASE WHEN rev IS NULL THEN NULL WHEN lower(rev) = 'head' THEN 'head' WHEN starts_with(rev, 'HEAD~') THEN 'head_n' WHEN regexp_matches(rev, '^[0-9a-f]{4,40}$') THEN 'sha' WHEN starts_with(rev, '@') THEN 'ref' ELSE 'other' END"
_ERRORS = "CASE " + " ".join(f"WHEN regexp_matches(lower(raw), {q(p)}) THEN '{k}'" for k, p in T.ERROR_KINDS) + " END"
_OWN = f"regexp_replace(raw, {q(T.INJECTED)}, '', 'g')"
_BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '(?m)^```.*$', '', 'g'), '(?m)^\\s{0,3}(#{1,6}|>|[-*+]|[0-9]+\\.)\\s+', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '(\\*\\*|__|`)', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"
_LABEL = "left(coalesce(command, path, query, tool, 'tool'), 40)"


def _sql(body: str, *more: str) -> str:
    return f"WITH {', '.join([_BASE, *(m.strip().rstrip(',') for m in more)])} {body}"


_ID = """
i0 AS (SELECT *, coalesce({norm}, '') AS np, coalesce({sq}, '') AS nq FROM ev),
i1 AS (SELECT *, CASE WHEN np <> '' THEN np ELSE coalesce(s_scope, '') END AS sc, CASE WHEN nq <> '' THEN nq ELSE coalesce(s_query, '') END AS aq, CASE WHEN np <> '' THEN np WHEN coalesce({nr}, '') <> '' THEN {nr} ELSE 'path-missing' END AS tg,
  CASE WHEN h_path IS NOT NULL THEN 1 WHEN s_query IS NOT NULL THEN 2 WHEN prb IS NOT NULL THEN 3 WHEN r_path IS NOT NULL THEN 4 WHEN family = 'file_read' AND np <> '' THEN 5 WHEN family = 'search' OR nq <> '' THEN 6 END AS k FROM i0),
i AS (SELECT *, aq || '|' || sc AS an, regexp_matches(tg, '{tmp}') AS tmp FROM i1)
""".format(norm=_norm("path"), sq=_squeezed("query"), nr=_norm("r_path"), tmp=C.TEMPORARY)

ORACLES = {
    "shell_commands": _sql(f"SELECT session_id, turn, pos, shell, root, r_path AS read_path, s_query AS query, s_scope AS scope, h_path AS past_path, {_REV} AS revision, prb AS probe, d_path AS dir_path, d_mode AS dir_mode, kept, lp AS lists_paths FROM sh WHERE shell IS NOT NULL", _SHELL, _parsed("forms", "shell", "sh")),
    "event_identities": _sql(
        f"""SELECT session_id, turn, pos, {_args()} AS arguments, CASE WHEN family = 'file_read' OR r_path IS NOT NULL THEN 'file_read|' || tg WHEN family = 'search' OR s_query IS NOT NULL THEN 'search|' || aq || '|' || sc || '|' || {_args(I.OWN)}
        WHEN d_path IS NOT NULL THEN 'listing|' || CASE WHEN np <> '' THEN np WHEN d_path <> '' THEN d_path ELSE 'path-missing' END || '|' || d_mode END AS evidence_key,
        CASE k WHEN 1 THEN 'file_history' WHEN 2 THEN 'search' WHEN 3 THEN CASE WHEN prb IN ('ls', 'find') THEN 'listing' ELSE 'file_metadata' END WHEN 4 THEN 'file_current' WHEN 5 THEN 'file_current' WHEN 6 THEN 'search' END AS domain,
        CASE k WHEN 1 THEN h_path WHEN 2 THEN an WHEN 3 THEN CASE WHEN np <> '' THEN np ELSE prb END WHEN 4 THEN tg WHEN 5 THEN tg WHEN 6 THEN an END AS anchor,
        CASE k WHEN 1 THEN 'diff' WHEN 2 THEN 'search_results' WHEN 3 THEN 'metadata' WHEN 4 THEN CASE WHEN tmp THEN 'copy' ELSE 'full' END WHEN 5 THEN 'full' WHEN 6 THEN 'search_results' END AS variant,
        CASE k WHEN 1 THEN {_REV} WHEN 2 THEN an WHEN 3 THEN prb WHEN 4 THEN '' WHEN 5 THEN '' WHEN 6 THEN an END AS novelty,
        CASE k WHEN 1 THEN 'git_history' WHEN 2 THEN 'shell_search' WHEN 3 THEN 'metadata_probe' WHEN 4 THEN CASE WHEN tmp THEN 'temp_copy' ELSE 'shell_read' END WHEN 5 THEN 'native_tool' WHEN 6 THEN 'native_tool' END AS source,
        coalesce(CASE WHEN family = 'file_read' THEN CASE WHEN np <> '' THEN np ELSE r_path END WHEN family = 'search' THEN CASE WHEN nq <> '' AND np <> '' THEN nq || ' @ ' || np ELSE nullif(nq, '') END WHEN family = 'command' THEN program END, '') AS label,
        left(sha256(tool || ':' || {_args()}), 12) AS result_key, tool || ':' || left(sha256({_args(('offset', 'limit'))}), 16) AS semantic_key, family FROM i WHERE tool IS NOT NULL""",
        _parsed("x", "command", "ev"), _ID,
    ),
    "result_predicates": _sql(
        f"""SELECT session_id, turn, pos, {_ERRORS} AS error_kind, regexp_matches(raw, {q('(?m)^' + chr(92) + 's*(?:' + chr(92) + '.?/)?[A-Za-z0-9_./-]+' + chr(92) + '.(?:' + T.SOURCES + '):[0-9]+(?::|' + chr(92) + 's|$)')}) AS source_lines,
        CASE WHEN family = 'search' THEN CASE WHEN len(list_filter({_SPLIT}, lambda v: regexp_matches(v, {q(T.SEARCH_LINE)}) OR regexp_matches(v, {q(T.CONTEXT_LINE)}))) > 0 OR (regexp_matches(trim(raw), '(?s)^\\[.*\\]$') AND json_valid(raw) AND regexp_matches(lower(raw), {q(T.EVIDENCE_KEY)})) THEN 'exact_content' ELSE 'navigation' END END AS evidence_level,
        length(raw) >= 10 AND regexp_matches(raw, {q(T.WIRE)}) AS markup,
        trim({_OWN}) <> '' AND NOT regexp_matches(lower(trim({_OWN})), '(?m)traceback \\(most recent call last\\)|command not found|no such file or directory|fatal:|^error:')
          AND NOT coalesce(program = 'pytest' AND regexp_matches(lower(trim({_OWN})), '=+\\s+failures?\\s+=+|\\bfailed\\b|\\berrors?\\b'), false) AND NOT coalesce(program IN ('ruff', 'mypy') AND contains(lower({_OWN}), 'error') AND NOT contains(lower({_OWN}), 'success:'), false) AS keepable,
        len(list_distinct(regexp_extract_all(raw, {q('([A-Za-z0-9_./-]+' + chr(92) + '.(?:' + T.NAMED + '))' + chr(92) + 'b')}, 1)))::INT AS n_files, length({_OWN})::INT AS n_own, s AS summary,
        CASE WHEN length(raw) <= 60 THEN raw WHEN ep > 0 THEN substr(raw, greatest(1, least(ep - 30, length(raw) - 59)), 60) ELSE left(raw, 60) END AS clip, left(sha256({_BARE}), 16) AS bare
        FROM (SELECT *, (SELECT coalesce(string_agg(v, ' | ' ORDER BY i), '') FROM (SELECT *, sum(length(v) + CASE WHEN n > 1 THEN 3 ELSE 0 END) OVER (ORDER BY i) AS upto FROM (SELECT *, row_number() OVER (ORDER BY i) AS n FROM (SELECT trim(t, ' ') AS v, i FROM (SELECT unnest(f) AS t, unnest(range(len(f))) AS i)) WHERE v <> '')) WHERE upto <= 160) AS s
          FROM (SELECT *, list_slice({_SPLIT}, 1, 6) AS f, CASE WHEN regexp_matches(lower(raw), '{'|'.join(T.ERROR_MARKS)}') THEN length(regexp_extract(lower(raw), '(?s)^(.*?)(?:{'|'.join(T.ERROR_MARKS)})', 1)) + 1 ELSE 0 END AS ep FROM x WHERE raw IS NOT NULL))"""
    ),
    "protected_reads": _sql(
        f"""SELECT session_id, turn, pos, path, base IN ('readme.md', 'changelog.md', 'release.md') AND (regexp_matches(p, '(^|/)docs/') OR base = 'readme.md') AS document, regexp_matches(p, '(bridge|collector)\\.log$|\\.log$') AS log, regexp_matches(p, '(^|/)(docs|spec)/') AS in_docs
        FROM (SELECT *, regexp_extract(p, '([^/]*)$', 1) AS base FROM (SELECT *, lower({_norm('path')}) AS p FROM x WHERE family = 'file_read' AND path IS NOT NULL))"""
    ),
    "tool_call_labels": _sql(f"SELECT tool_use_id, arg_max({_LABEL}, (session_id, turn, pos)) AS label FROM x WHERE tool_use_id IS NOT NULL GROUP BY 1"),
    "causal_failures": _sql(
        f"""SELECT session_id, left(regexp_replace({_LABEL} || '>' || left(trim(list_filter({_SPLIT}, lambda v: trim(v, ' ') <> '')[1], ' '), 50), '\\s+', '_', 'g'), 60) AS failure, count(*) AS n, count(*) * 3 AS weight FROM x WHERE regexp_matches(lower(raw), '{'|'.join(T.ERROR_MARKS)}') GROUP BY ALL"""
    ),
    "history_rewrite_skips": _sql(
        """SELECT session_id, n_uses, n_results, n_reads, n_commands, n_heavy, reason, reason = 'tool_volume_heavy' AS skip FROM (SELECT *, CASE WHEN n_results / n_messages >= 0.35 AND n_results >= 8 THEN 'tool_density_high' WHEN n_uses >= 10 THEN 'tool_use_count_high' WHEN n_reads >= 6 AND n_commands >= 5 THEN 'file_and_command_heavy' WHEN n_heavy >= 6 THEN 'tool_volume_heavy' ELSE '' END AS reason
        FROM (SELECT t.session_id, 2 * count(*) AS n_messages, sum(len(tool_uses))::BIGINT AS n_uses, sum(len(tool_results))::BIGINT AS n_results, sum(coalesce(r, 0))::BIGINT AS n_reads, sum(coalesce(c, 0))::BIGINT AS n_commands, sum(len(list_filter(tool_results, lambda v: length(v.content) > 800)))::BIGINT AS n_heavy
          FROM t LEFT JOIN (SELECT session_id, turn, count(*) FILTER (family = 'file_read') AS r, count(*) FILTER (family = 'command') AS c FROM x GROUP BY ALL) f ON f.session_id = t.session_id AND f.turn = t.turn_index GROUP BY t.session_id))"""
    ),
    "repeat_trackers": _sql(
        f"""SELECT session_id, turn, pos, (row_number() OVER (PARTITION BY session_id, c ORDER BY turn, pos) - 1)::INT AS n_same_call, (row_number() OVER (PARTITION BY session_id, target ORDER BY turn, pos) - 1)::INT AS n_same_target, count(*) OVER (PARTITION BY session_id, turn, c) - 1 AS n_in_turn
        FROM (SELECT *, tool || '|' || {_args()} AS c FROM x WHERE family IS NOT NULL)"""
    ),
}
