"""What a query string asks for: words, intent, synonyms, parts. Columns only, so whole query logs are read at once.

Defined results: a null query has null words and the intent of an empty one (narrow); an empty query has no words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as X

#: Words a query's intent is told by.
STOP = "a an the in on at for of with and or is are was were be been being have has had do does did will would could should may might must can from to by as into about between through this that these those new".split()
ASKING = "how what why where when".split()
VERBS = "find check implement add fix optimize refactor debug review test remove update create delete improve investigate audit migrate replace extract".split()
DEBUG = "error bug broken failing crash exception undefined null wrong unexpected".split()
BROAD = "architecture connect connects connected explain overview structure lifecycle journey boundary pipeline flow system management pattern patterns strategy layer layers module modules integration orchestration synchronization migration authorization authentication".split()
FLOW = "flow route routes handler handlers request response submission submit callback session auth oauth".split()
#: Modules and the words that imply them.
MODULES = {
    "auth": "authentication login session token jwt password credential", "db": "database query sql schema migration table index",
    "api": "endpoint route handler request response middleware controller", "ui": "component view page template render layout style",
    "test": "spec assert mock fixture coverage validation", "capsule": "generator packer formatter compression scoring",
    "graph": "bfs traversal graph graphs hop hops neighbor neighbors pagerank centrality",
}
MULTIPLIER = {"symbol-lookup": 0.75, "narrow": 1.0, "debug": 1.25, "broad": 1.5, "task": 2.0}
#: Words that a query's focus is told by.
FOCUS = {
    "test": "test tests spec specs fixture fixtures mock mocks assert assertion jest vitest",
    "config": "config configuration settings workflow workflows github actions action ci build lint release deploy deployment package manifest tsconfig eslint prettier tailwind postcss vite vitest jest",
    "type": "type types typing interface interfaces generic generics declaration declarations typedef typedefs signature signatures dts",
    "ui": "ui ux component components view views page pages modal form",
    "doc": "doc docs documentation readme guide tutorial manual changelog plan plans",
    "runtime": "api auth callback compiler controller dispatch endpoint fetch flow handler hook hooks http lifecycle middleware pipeline request response route router routing runtime schema server service session stack validation validator",
}
#: Verbs in a name or signature that tell of an action.
ACTIONS = "submit create send load get save persist fetch update delete exchange verify handle route authenticate write read sync callback notify".split()
#: A word and its synonyms.
SYNONYMS = {line.split(":")[0].strip(): line.split(":")[1].split() for line in """
notification: toast alert banner snackbar message
toast: notification alert snackbar
auth: authentication authorization login signin sso oauth session token jwt credential
authentication: auth authorization login signin session jwt credential
authorization: auth authentication permission role access credential
login: auth signin authentication session
jwt: auth authentication token session oauth
oauth: auth authentication jwt token sso
user: account profile member
error: exception fault failure panic throw catch crash
exception: error fault failure throw catch panic
throw: error exception panic raise
modal: dialog popup overlay
nav: navigation menu sidebar header
route: router routing endpoint handler
router: route routing middleware
routing: route router middleware
registration: register setup mount use
register: registration mount use
dispatch: handle handler invoke execute
chain: flow pipeline stack
compiler: compile validator controller
validation: validate validator check sanitize schema
config: configuration settings preferences options environment env flags
db: database store repository repo sql orm query migration schema table model
database: db sql orm store repository migration schema table model
migration: db database schema orm upgrade rollback
orm: db database model migration sql repository
api: endpoint route handler controller rest graphql
endpoint: api route handler controller
cache: memoize memo memoization store redis ttl invalidate lru
lru: cache memoize eviction ttl
redis: cache queue pub sub broker
validate: verify check sanitize schema
entry: handler route request login
lead: inquiry contact prospect
capture: submit create intake form
lifecycle: flow pipeline journey route
inquiry: lead contact submission
index: indexer indexproject scan
parser: parse parsing parsefile parse-result
generation: generate generator build compose
scoring: score scorer ranking rank
compression: compress compressor packing packer formatter
capsule: context retrieval generator formatter
bfs: weightedbfstraversal traversal graph hops
traversal: bfs weightedbfstraversal search walk
graph: bfs traversal neighbors hops
symbol: function class variable method type interface
queue: job worker broker task background celery sidekiq bull
job: queue worker task background cron schedule
worker: queue job background task consumer
event: emit listener subscribe publish dispatch signal handler callback
emit: event publish dispatch signal
subscribe: event listen consume observe
middleware: interceptor guard filter hook pipe
interceptor: middleware guard filter hook
guard: middleware interceptor auth permission
state: store reducer context reactive signal atom zustand redux
redux: state store reducer action dispatch
zustand: state store atom reactive
reducer: state redux store action
ratelimit: throttle quota backoff limiter
throttle: ratelimit quota backoff debounce
test: spec describe it expect assert mock stub fixture
deploy: deployment ci cd pipeline release build
ci: deploy pipeline build test automation
cd: deploy pipeline release automation
pipeline: ci cd deploy flow chain stage
architecture: design pattern structure system component module layer
design: architecture pattern structure layout
structure: architecture design pattern layout hierarchy
""".strip().splitlines()}
#: Verbs and what a hypothetical function of a query is named by.
VERB_FORMS = "authenticate:authenticate authentication:authenticate auth:authenticate login:login validate:validate validation:validate handle:handle process:process processing:process create:create creating:create update:update updating:update delete:delete deleting:delete fetch:fetch fetching:fetch load:load loading:load render:render rendering:render parse:parse parsing:parse transform:transform transforming:transform submit:submit submitting:submit send:send sending:send receive:receive receiving:receive connect:connect connecting:connect disconnect:disconnect initialize:initialize initializing:initialize configure:configure configuring:configure manage:manage managing:manage schedule:schedule scheduling:schedule"
PLAIN_STOP = "a an the is are was were be been being have has had do does did will would could should may might can shall of in to for with on at by from as into through during before after about between under above and or but not no this that these those it its my your i we you they he she".split()
#: Groups of words that a task's parts look for, by module and by verb, and where neither has any.
_FIND = "error handling validation|edge cases guards|pipeline flow output"
_ADD = "registration server tool|schema validation types|integration handler tests"
_FAST = "performance queries hotpaths|cache latency loops|index batch throughput"
_SHAPE = "interfaces types contracts|modules boundaries dependencies|tests coverage safety"
_DROP = "usages references imports|cleanup orphaned unused|tests coverage safety"
TASK_PARTS = {
    **dict.fromkeys(("find", "check", "debug", "investigate", "audit", "fix"), _FIND), **dict.fromkeys(("implement", "add", "create", "update", "migrate"), _ADD), **dict.fromkeys(("optimize", "improve"), _FAST),
    **dict.fromkeys(("refactor", "replace", "extract"), _SHAPE), **dict.fromkeys(("remove", "delete"), _DROP),
    "review": "tests coverage assertions|interfaces types contracts|error handling validation", "test": "tests coverage assertions|fixtures mocks setup|edge cases regression",
}
MODULE_PARTS = {
    "auth": "login session token|password credential hash|middleware guard permission", "api": "route handler controller|endpoint middleware request|response schema validation",
    "db": "query schema migration|model table index|connection pool transaction", "ui": "component props state|render layout style|event handler hook",
    "test": "fixture mock setup|assertion expect coverage|integration regression snapshot", "capsule": "generator packer formatter|compression scoring budget|pivot search retrieval",
    "graph": "bfs traversal graph|weightedbfstraversal distance hops|queue neighbors visited",
}
OTHER_PARTS = "architecture flow dependencies|interfaces types validation|tests coverage safety"


def listed(words: list[str]) -> Column:
    """The words as one literal that is split when the plan is made: a literal for each would take longer to build than to run."""
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def lookup(pairs: dict[str, str]) -> Column:
    return F.str_to_map(F.lit(";".join(f"{k}:{v}" for k, v in pairs.items())), F.lit(";"), F.lit(":"))


def synonyms_of(word: Column) -> Column:
    found = lookup({w: " ".join(others) for w, others in SYNONYMS.items()})[word]
    return F.when(found.isNotNull(), F.split(found, " ")).otherwise(F.array().cast("array<string>"))


def tokens(query: Column) -> Column:
    """Words of two characters or more, as written."""
    return F.filter(F.split(F.regexp_replace(query, r"[^a-zA-Z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 1)


def content(query: Column) -> Column:
    return F.filter(tokens(query), lambda w: ~F.array_contains(listed(STOP), F.lower(w)))


def verbs(query: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(content(query), F.lower), lambda w: F.array_contains(listed(VERBS), w)))


def terms(query: Column) -> Column:
    """The words left of stop words, verbs of tasks and question words, lower case, each once."""
    return F.array_distinct(F.filter(F.transform(content(query), F.lower), lambda w: ~F.array_contains(listed(VERBS + ASKING), w)))


def has_any(words: Column, known: list[str]) -> Column:
    return F.arrays_overlap(words, listed(known))


def intent(query: Column) -> Column:
    """symbol-lookup, debug, task, broad or narrow."""
    t = terms(query)
    asks = has_any(F.transform(content(query), F.lower), ASKING)
    out = F.when(F.trim(query).rlike(r"^[a-zA-Z_$][a-zA-Z0-9_$]*$"), "symbol-lookup").when(has_any(t, DEBUG), "debug").when(F.size(verbs(query)) > 0, "task")
    out = out.when(has_any(t, BROAD) | query.rlike(r"(?i)end.to.end"), "broad").when(asks & (F.size(t) < 5), "narrow").when(F.size(t) >= 5, "broad")
    return out.otherwise("narrow")


def focus_terms(query: Column) -> Column:
    """Words with a capital, an underscore or seven characters; where there are none, the first two terms, three of a task."""
    marked = F.filter(content(query), lambda w: ~F.array_contains(listed(VERBS + ASKING), F.lower(w)) & (w.rlike("[A-Z_]") | (F.length(w) >= 7)))
    marked = F.array_distinct(F.transform(marked, F.lower))
    return F.when(F.size(marked) > 0, marked).otherwise(F.slice(terms(query), 1, F.when(intent(query) == "task", 3).otherwise(2)))


def modules(query: Column) -> Column:
    known = {m: [m, *words.split()] for m, words in MODULES.items()}
    found = F.transform(terms(query), lambda t: F.array_compact(F.array(*[F.when(F.array_contains(listed(words), t), m) for m, words in known.items()])))
    return F.array_distinct(F.flatten(found))


def budget_multiplier(query: Column) -> Column:
    kind = intent(query)
    out = F.when(kind == "narrow", 1.0)
    for name, factor in MULTIPLIER.items():
        out = out.when(kind == name, factor)
    return out


def synonyms(words: Column) -> Column:
    """The words, lower case, and behind them the synonyms of each, every one once."""
    low = F.transform(words, F.lower)
    return F.array_distinct(F.concat(low, F.flatten(F.transform(low, synonyms_of))))


def coverage_groups(words: Column) -> Column:
    """For each word an array of it and its synonyms."""
    return F.transform(F.transform(words, F.lower), lambda w: F.concat(F.array(w), synonyms_of(w)))


def is_broad_prose(query: Column) -> Column:
    """More than three words and no identifier among them."""
    return (F.size(F.split(F.trim(query), r"\s+")) > 3) & ~query.rlike("[a-z][A-Z]|[a-z]_[a-z]")


def is_natural(query: Column) -> Column:
    """More than two words, two of them with content, and no identifier or dotted name."""
    words = F.split(F.trim(query), r"\s+")
    return ~query.rlike(r"[a-z][A-Z]|[a-z]_[a-z]|\w\.\w") & (F.size(words) > 2) & (F.size(F.filter(words, lambda w: ~F.array_contains(listed(PLAIN_STOP), F.lower(w)))) >= 2)


def hypothetical(query: Column) -> Column:
    """A function that would answer the query: its last known verb with the other words as nouns; the query itself where no noun is left."""
    known = lookup(dict(pair.split(":") for pair in VERB_FORMS.split()))
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9\s]", " "), r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(listed(PLAIN_STOP), w))
    nouns = F.filter(words, lambda w: known[w].isNull())
    forms = F.filter(F.transform(words, lambda w: known[w]), lambda v: v.isNotNull())
    verb = F.when(F.size(forms) > 0, F.element_at(forms, -1)).otherwise("handle")
    name = F.concat(verb, F.array_join(F.transform(nouns, lambda n: F.concat(F.upper(F.substring(n, 1, 1)), n.substr(F.lit(2), F.length(n)))), ""))
    code = F.concat(F.lit("function "), name, F.lit("("), F.get(nouns, F.lit(0)), F.lit(": any): any { /* "), verb, F.lit(" "), F.array_join(nouns, " "), F.lit(" - "), query, F.lit(" */ }"))
    return F.when(F.size(nouns) > 0, code).otherwise(query)


def split_terms(words: Column) -> Column:
    """Each word, the words of its identifier and those joined again; lower case, two characters or more, no stop words, each once."""
    def parts(w: Column) -> Column:
        split = X.split_identifier(w)
        return F.concat(F.array(F.trim(w)), split, F.when(F.size(split) > 1, F.array(F.array_join(split, ""))).otherwise(listed([])))

    flat = F.transform(F.flatten(F.transform(words, parts)), lambda w: F.trim(F.lower(w)))
    return F.array_distinct(F.filter(flat, lambda w: (F.length(w) > 1) & ~F.array_contains(listed(PARTS_STOP), w)))


PARTS_STOP = STOP[:-5]


def in_threes(words: Column) -> Column:
    """Up to three words together stay one group; more are cut into groups of three."""
    return F.when(F.size(words) == 0, F.array().cast("array<array<string>>")).when(F.size(words) < 4, F.array(words)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(3)), lambda i: F.slice(words, i, F.lit(3))))


def base_terms(query: Column) -> Column:
    first = split_terms(F.concat(focus_terms(query), terms(query)))
    return F.when(F.size(first) > 0, first).otherwise(split_terms(F.split(F.regexp_replace(query, r"[^A-Za-z0-9_\s]", " "), r"\s+")))


def parts(query: Column, most: int = 4) -> Column:
    """Sub-queries (terms, share of the budget, priority) of a query: up to four by threes of a broad one, by module or verb of a task, else one."""
    base = base_terms(query)
    bundles = lambda keys, pairs: F.slice(F.array_distinct(F.flatten(F.transform(F.filter(keys, lambda k: lookup(pairs)[k].isNotNull()), lambda k: F.split(lookup(pairs)[k], r"\|")))), 1, most)
    by_module, by_verb = bundles(modules(query), MODULE_PARTS), bundles(verbs(query), TASK_PARTS)
    bundle = F.when(F.size(by_module) > 0, by_module).when(F.size(by_verb) > 0, by_verb).otherwise(F.split(F.lit(OTHER_PARTS), r"\|"))
    weight = lambda i: F.when(i == 0, 1.25).when(i == 1, 1.1).otherwise(1.0)
    total = lambda n: 2.35 + (n - 2)
    task = F.transform(bundle, lambda b, i: F.struct(F.slice(split_terms(F.concat(base, F.split(b, " "))), 1, 10).alias("terms"), (weight(i) / total(F.size(bundle))).alias("share"), (i + 1).alias("priority")))
    single = F.array(F.struct(base.alias("terms"), F.lit(1.0).alias("share"), F.lit(1).alias("priority")))
    groups = F.slice(in_threes(base), 1, most)
    broad = F.transform(groups, lambda g, i: F.struct(g.alias("terms"), (F.lit(1.0) / F.size(groups)).alias("share"), (i + 1).alias("priority")))
    kind = intent(query)
    return F.when(kind == "task", task).when((kind == "broad") & ((F.size(base) > 5) | has_any(base, FLOW)), broad).otherwise(single)


def class_of(query: Column, pivots: Column) -> Column:
    """task, narrow or broad, as diagnosis sees a query."""
    words = F.filter(F.split(F.regexp_replace(F.lower(query), r"[^a-z0-9_\s]", " "), r"\s+"), lambda w: F.length(w) > 1)
    return F.when(has_any(words, VERBS), "task").when((F.size(words) <= 3) & (pivots <= 30), "narrow").otherwise("broad")


def reference(name: Column) -> tuple[Column, Column, Column]:
    """(path, owner, name) of ``file.ts:Owner.name``, ``file::name``, ``Owner.name`` or a bare name; empty where a part is missing."""
    path = F.regexp_extract(name, r"^(.*?\.[A-Za-z0-9]+):{1,2}", 1)
    rest = F.when(path != "", F.regexp_replace(name, r"^.*?\.[A-Za-z0-9]+:{1,2}", "")).otherwise(name)
    return path, F.regexp_extract(rest, r"^(.*)\.[^.]*$", 1), F.regexp_extract(rest, r"([^.]*)$", 1)


def delimited(pattern: Column) -> tuple[Column, Column]:
    """(expression, flags) of ``/expression/flags``; anything else is the expression itself without flags."""
    inside = F.regexp_extract(pattern, r"^/(.+)/([a-z]*)$", 1)
    return F.when(inside != "", inside).otherwise(pattern), F.regexp_extract(pattern, r"^/(.+)/([a-z]*)$", 2)


def search_words(text: Column) -> Column:
    """The word characters of a search term, for full-text patterns; words of two characters or more."""
    return F.filter(F.split(F.trim(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", " ")), r"\s+"), lambda w: F.length(w) >= 2)
