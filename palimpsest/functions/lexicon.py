"""Rule-based text signals as column expressions (one pass, inside code generation).

All functions take a text column and treat null as empty.  Patterns are those of the data
model's rules and are kept in one place; they are written for Java's and RE2's common subset
unless noted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: patterns, weights and word lists that results depend on -----------------------

EXPLICIT = [r"\bremember this\b", r"\bimportant\b", r"\bnote:"]
DECISION = [r"\blet'?s go with\b", r"\bwe decided\b", r"\bthe plan is\b"]
CORRECTION = [r"\bno,?\s+actually\b", r"\bthat'?s wrong\b", r"\bnot like that\b"]
PREFERENCE = [r"\bI prefer\b", r"\bI always\b", r"\bI never\b"]
EMOTIONAL = [r"\bfrustrated\b", r"\bcritical\b", r"\burgent\b", r"\bexcited\b"]
ACKNOWLEDGED = [r"^(ok|okay|thanks|thank you|sure|got it|sounds good)[!.]?$"]
SALIENCE_WEIGHTS = ((0.95, EXPLICIT), (0.90, DECISION), (0.85, CORRECTION), (0.85, PREFERENCE), (0.80, EMOTIONAL))

INTENTS = {
    "TASK_START": [r"\b(let'?s|i need to|i want to|we should|build|create|implement|add|make)\b", r"\b(start|begin|set up|initialize)\b.*\b(project|feature|module|component)\b"],
    "TASK_CONTINUE": [r"\b(next|continue|proceed|go on|where were we|what'?s next)\b", r"\b(step \d|move on|keep going)\b"],
    "QUESTION": [r"\?$", r"\b(what|who|where|when|why|how|which|explain|describe|tell me)\b"],
    "RECALL_EXPLICIT": [r"\b(remember|recall|we (discussed|talked|decided|agreed)|last time|previously)\b", r"\b(what did (we|i|you)|did we ever|have we)\b"],
    "DEBUGGING": [r"\b(error|bug|broken|fail|crash|exception|not working|issue|wrong)\b", r"\b(debug|fix|troubleshoot|investigate)\b", r"^(Error|TypeError|ReferenceError|SyntaxError):"],
    "PREFERENCE": [r"\b(i (prefer|like|want|hate|dislike|never|always))\b", r"\b(don'?t (use|do|make|add)|please (always|never))\b"],
    "REVIEW": [r"\b(review|check|look at|audit|inspect|lgtm)\b", r"\b(code review|pr review|pull request)\b"],
    "CONTEXT_SWITCH": [r"\b(actually|instead|switch|change topic|different thing|forget that)\b", r"\b(let'?s talk about|moving on to|pivoting to)\b"],
    "EMOTIONAL": [r"\b(critical|urgent|asap|important|priority|production( is)? down)\b", r"\b(frustrated|confused|stuck|blocked|desperate)\b", r"!{2,}"],
    "SOCIAL": [r"^(hi|hey|hello|thanks|thank you|ok|okay|sure|yes|no|yep|nope|lol|haha)\s*[.!]?$"],
}
SCORED_INTENTS = ("TASK_START", "TASK_CONTINUE", "QUESTION", "DEBUGGING", "PREFERENCE", "REVIEW", "CONTEXT_SWITCH")

EMOTIONS = {
    "excited": [r"\b(excited|awesome|amazing|fantastic|love it|great news|thrilled|pumped)\b", r"!{2,}", r"\b(can'?t wait|looking forward|let'?s go)\b"],
    "frustrated": [r"\b(frustrated|annoyed|stuck|blocked|broken|hate|ugh|damn|aargh)\b", r"\b(not working|keeps? failing|still (broken|stuck|wrong))\b", r"\b(wast(ed?|ing) time|going in circles|ridiculous)\b"],
    "urgent": [r"\b(urgent|asap|critical|emergency|production( is)? down|blocking)\b", r"\b(immediately|right now|drop everything)\b"],
    "curious": [r"\b(curious|interesting|wonder|hmm|intriguing|fascinated)\b", r"\b(what if|how does|i wonder|could we)\b"],
    "determined": [r"\b(determined|committed|going to|must|will not stop|push through)\b", r"\b(no matter what|whatever it takes|let'?s do this)\b"],
    "confused": [r"\b(confused|don'?t understand|what does|makes no sense|lost)\b", r"\b(huh|wait what|i'?m not following|unclear)\b"],
    "satisfied": [r"\b(satisfied|pleased|glad|happy with|works? (perfectly|great|well))\b", r"\b(nailed it|exactly right|that'?s it|perfect)\b"],
}

SKIP_MODE = r"^(hi|hey|hello|thanks|thank you|ok|okay|sure|yes|no|yep|nope|lol|haha|hmm|ah|oh|done|got it)\s*[.!]?$"
DEEP_MODE = r"\b(remember|recall|what did|did we|last time|previously|have we|remind me)\b"
#: results, association hops and recency bias of the three recall modes
MODE_PARAMS = {"skip": (0, 0, 0.0), "light": (30, 0, 0.4), "deep": (30, 2, 0.2)}

CAPITALIZED = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\b"
CAPITAL_STOP = "What When Where Who Why Which How Did Do Does Is Was Were Are Can Could Would Should Will Have Has Had Tell Explain Describe Before After During".split()
NAMES_AND = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\s+and\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}\b"
RELATIONAL = [
    r"\b(?:between|among)\b", r"\bwhere\s+(?:did|do|does|will|were|was)\b", r"\bhow\s+did\s+\w+\s+(?:meet|know|react|find|discover)", r"\bwho\s+(?:else|also)\b",
    r"\b(?:more|less|fewer|greater|higher|lower|older|younger|taller|shorter)\b", r"\b(?:compared\s+to|versus|vs\.?)\b", r",\s*\w+\s+or\s+\w+\?",
]
COUNTING = [r"\bhow\s+(?:many|often|much)\b", r"\b(?:count|total|sum|number of)\b", r"\b(?:first|last|earliest|latest)\s+time\b", r"\bever\s+(?:since|before|after)\b"]
_TIMES = "january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
TEMPORAL = [
    r"\b(?:when|what\s+(?:year|date|month|day|time))\b", rf"\b(?:before|after|during|since|until|by)\s+(?:the\s+|a\s+|\d|{_TIMES})\b", r"\b(?:yesterday|today|tomorrow|tonight)\b",
    rf"\b(?:last|this|next|previous|past)\s+(?:week|month|year|day|time|night|morning|afternoon|evening|weekend|{_TIMES})\b",
    r"\b(?:a|an|\d+|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:day|week|month|year|hour|minute)s?\s+ago\b",
    r"\b(?:recently|earlier|later|afterwards|beforehand|meanwhile)\b", r"\b(?:19|20)\d{2}\b", r"\bhow\s+long\s+(?:ago|between|did|since|until)\b",
]

SYNTH_TEMPORAL = [
    r"\bhow long\b", r"\bhow many (?:days?|weeks?|months?|years?|hours?|minutes?)\b", r"\bhow much time\b", r"\bwhen (?:did|was|were|do|does|is|had)\b", r"\bwhat (?:year|month|date|day|time)\b",
    r"\b(?:days?|weeks?|months?|years?|hours?)\s+(?:ago|apart|before|after|between|since|until|passed|elapsed|later|earlier|prior)\b", r"\b(?:passed|elapsed)\s+(?:since|between|from)\b",
    r"\b(?:first|last|earliest|latest)\s+time\b", r"\bmost recent(?:ly)?\b", r"\b(?:order|sequence)\b.{0,80}\b(?:first|last|earliest|latest|events?)\b", r"\bfrom (?:first|earliest) to (?:last|latest)\b",
    r"\b(?:happened|occurred|came|took place)\s+(?:first|last|earlier|earliest|later|latest)\b", r"\b(?:which|who)\b.{0,60}\b(?:first|last|earlier|later)\b", r"\bbefore or after\b", r"\bon what (?:day|date)\b",
]
SYNTH_AGGREGATION = [r"\bhow many\b", r"\bhow (?:often|much)\b", r"\b(?:in total|altogether|combined|total (?:number|amount|count)|number of|count of|sum of)\b", r"\b(?:list|name) (?:all|every|each)\b", r"\ball (?:the|of the)\b.{0,60}\b(?:I|we|my)\b"]
PREFERENCE_REQUEST = [
    r"\b(?:recommend|suggest)(?:ations?|ions?|ed|s)?\b", r"\b(?:advice|advise)\b", r"\bwhat should i\b", r"\bany (?:good\s+)?(?:tips|ideas?|recommendations?|suggestions?)\b", r"\bany\b.{0,50}\b(?:recommendations?|suggestions?|tips|ideas?)\b",
    r"\bhelp me (?:choose|pick|find|plan|decide)\b", r"\btips (?:for|on)\b", r"\bwhat do you think\b", r"\bdo you think\b", r"\blooking for\b",
]
PAST_ASSISTANT = r"\b(?:what|which)\b.{0,30}\b(?:did|had|have)\s+you\b|\byou (?:recommended|suggested|advised|mentioned|told|gave)\b"
#: first and sixth rule with lookahead: Java only
PREFERENCE_CONTENT = [
    r"\bI(?:'d| would)? prefer\b", r"\bI (?:always|never|usually) (?!said\b|thought\b|assumed\b|knew\b|meant\b|told\b|wondered\b)\w+", r"\bI (?:don't|do not|can't|cannot) (?:like|eat|drink|stand|tolerate|use|want|do)\b",
    r"\bI(?:'m| am) (?:allergic|vegetarian|vegan|lactose[- ]intolerant|gluten[- ]free)\b", r"\bplease (?:always|don't|do not|never|make sure)\b", r"\bmy (?:favorite|favourite|preferred|go-to)\b(?! .*used to)", r"\bmy budget (?:is|for|of)\b",
]

RECALL_FAILURE = r"\b(can'?t find|no record of|nothing stored|not finding|no luck|no mention|don'?t have.{0,20}(details|context|record)|genuinely (can'?t|don'?t)|searched.{0,30}(no|nothing|zero)|dug through everything)\b"
HEDGE = r"\b(but|however|though|although|except|still|yet)\b"

TECHNOLOGIES = [
    r"\b(TypeScript|JavaScript|Python|Rust|Go|Java|Kotlin|Swift|Ruby|PHP|C\+\+|C#)\b", r"\b(React|Vue|Angular|Next\.js|Nuxt|Svelte|SolidJS|Solid\.js|Qwik|Astro|Remix)\b", r"\b(Express|FastAPI|Django|Flask|Spring|NestJS|Fastify|Hono|Elysia)\b",
    r"\b(Node\.js|Deno|Bun|Docker|Kubernetes|Terraform|AWS|GCP|Azure|Vercel|Netlify|Cloudflare)\b", r"\b(PostgreSQL|MySQL|MongoDB|Redis|Supabase|Firebase|SQLite|DynamoDB|CockroachDB)\b", r"\b(Prisma|Drizzle|TypeORM|Sequelize|Knex|Kysely|pg)\b",
    r"\b(Git|GitHub|GitLab|Bitbucket|CircleCI|GitHub Actions|Jenkins)\b", r"\b(OpenAI|Claude|GPT-[34o]|Anthropic|LLM|pgvector|Ollama|LangChain|LlamaIndex)\b", r"\b(Vitest|Jest|Mocha|Playwright|Cypress|ESLint|Prettier|Webpack|Vite|tsup|esbuild|Rollup|Parcel)\b",
    r"\b(Tailscale|tRPC|GraphQL|REST|gRPC|WebSocket|OAuth|JWT)\b",
]
PROJECTS = [r"(?i)(?:the|our|my)\s+(\w[\w-]*(?:\s+\w[\w-]*)?)\s+project", r"(?i)(?:working on|building|developing)\s+(\w[\w-]*(?:-\w+)*)", r"\b([a-z]\w*-[a-z]\w*(?:-[a-z]\w*)*)\b"]
PERSONS = [r"(?:(?:tell|ask|cc|ping)\s+|@)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)", r"(?m)(?:^|[.!?]\s+)(?!(?:The|This|That|These|Those|What|How|Why|When|Where|Who|I|We|He|She|It|They|You|My|Our|His|Her|Its|Their|Your)\b)([A-Z][a-z]+\s+[A-Z][a-z]+)"]
NOT_PERSONS = "The This That These Those What How Why When Where Who Which There Here Some Any Each Every Both All Most Many Much More Other Another Such Same Good Great Best New Old First Last Next Previous Note True False".split()

EMOTION_WORDS = {"urgent": "urgent|asap|critical|deadline", "negative": "frustrated|angry|annoyed|upset|worried", "positive": "happy|excited|great|love|glad"}

# --- expressions ------------------------------------------------------------------------------


def hits(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike("(?i)" + pattern), F.lit(False))


def any_hit(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [hits(text, p) for p in patterns])


def count_hits(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [hits(text, p).cast("int") for p in patterns])


def salience(text: Column, repeated: Column | None = None) -> Column:
    """Strongest signal plus 0.05 a further signal, at most 0.99; 0.1 for acknowledgements, 0.3
    for none.  ``repeated``: whether the text repeats words of recent turns."""
    text = F.coalesce(text, F.lit(""))
    trimmed = F.trim(text)
    signals = [(w, any_hit(text, p)) for w, p in SALIENCE_WEIGHTS]
    signals += [(0.75, repeated if repeated is not None else F.lit(False)), (0.60, trimmed.endswith("?")), (0.50, F.contains(text, F.lit("```"))), (0.40, F.length(text) > 200)]
    found = F.array_compact(F.array(*[F.when(hit, F.lit(w)) for w, hit in signals]))
    score = F.least(F.lit(0.99), F.round(F.array_max(found) + 0.05 * (F.size(found) - 1), 2))
    return F.when(any_hit(trimmed, ACKNOWLEDGED), 0.10).when(F.size(found) == 0, 0.30).otherwise(score)


def salience_gate(base: Column, a: Column, b: Column, low: float = 0.15, full: float = 0.40) -> Column:
    """Strength scaled by the weaker of two saliences: none below ``low``, whole from ``full``."""
    return base * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.least(a, b) - low) / (full - low)))


def intent(text: Column) -> Column:
    """Eleven intents: short social, emotional, explicit recall, the most patterns, length."""
    t = F.trim(F.coalesce(text, F.lit("")))
    scores = F.array(*[F.struct(count_hits(t, INTENTS[n]).alias("n"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(SCORED_INTENTS)])
    best = F.array_max(scores)
    rest = F.when(best["n"] > 0, best["name"]).when(F.length(t) > 15, "INFORMATIONAL").otherwise("SOCIAL")
    return F.when((F.length(t) < 20) & any_hit(t, INTENTS["SOCIAL"]), "SOCIAL").when(any_hit(t, INTENTS["EMOTIONAL"]), "EMOTIONAL").when(any_hit(t, INTENTS["RECALL_EXPLICIT"]), "RECALL_EXPLICIT").otherwise(rest)


def content_intent(text: Column) -> Column:
    """Like ``intent``, but explicit recall competes by its count."""
    t = F.trim(F.coalesce(text, F.lit("")))
    names = ("RECALL_EXPLICIT", *SCORED_INTENTS)
    best = F.array_max(F.array(*[F.struct(count_hits(t, INTENTS[n]).alias("n"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    rest = F.when(best["n"] > 0, best["name"]).when(F.length(t) > 15, "INFORMATIONAL").otherwise("SOCIAL")
    return F.when((F.length(t) < 20) & any_hit(t, INTENTS["SOCIAL"]), "SOCIAL").when(any_hit(t, INTENTS["EMOTIONAL"]), "EMOTIONAL").otherwise(rest)


def emotion(text: Column) -> Column:
    """struct(label, intensity): the label with most patterns (two at least, first wins)."""
    t = F.coalesce(text, F.lit(""))
    best = F.array_max(F.array(*[F.struct(count_hits(t, p).alias("n"), F.lit(-i).alias("order"), F.lit(n).alias("name")) for i, (n, p) in enumerate(EMOTIONS.items())]))
    known = best["n"] >= 2
    level = F.when(best["n"] == 2, 0.5).otherwise(F.least(F.lit(0.95), 0.7 + 0.1 * (best["n"] - 3)))
    return F.struct(F.when(known, best["name"]).otherwise("neutral").alias("label"), F.when(known, level).otherwise(0.1).alias("intensity"))


def emotion_keywords(text: Column) -> Column:
    """All keyword labels of a text, urgent first."""
    return F.array_compact(F.array(*[F.when(hits(text, rf"\b({p})\b"), F.lit(n)) for n, p in EMOTION_WORDS.items()]))


def recall_mode(text: Column) -> Column:
    t = F.trim(F.coalesce(text, F.lit("")))
    return F.when((F.length(t) < 10) | hits(t, SKIP_MODE), "skip").when(F.contains(t, F.lit("?")) | hits(t, DEEP_MODE), "deep").otherwise("light")


def capitalized_spans(text: Column) -> Column:
    spans = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({CAPITALIZED})"), F.lit(1))
    return F.filter(spans, lambda s: ~F.split(s, " ")[0].isin(*CAPITAL_STOP))


def query_signals(text: Column) -> dict[str, Column]:
    """multi_hop, temporal and entity_count of a query."""
    n = F.size(capitalized_spans(text))
    joined = F.coalesce(text.rlike(NAMES_AND), F.lit(False))
    return {"multi_hop": any_hit(text, COUNTING) | joined | ((n >= 2) & any_hit(text, RELATIONAL)), "temporal": any_hit(text, TEMPORAL), "entity_count": n}


def synthesis_intent(text: Column) -> Column:
    return F.when(any_hit(text, SYNTH_TEMPORAL), "temporal").when(any_hit(text, SYNTH_AGGREGATION), "aggregation").otherwise("none")


def preference_request(text: Column) -> Column:
    return ~hits(text, PAST_ASSISTANT) & any_hit(text, PREFERENCE_REQUEST)


def preference_content(text: Column) -> Column:
    return any_hit(text, PREFERENCE_CONTENT)


def recall_failure(role: Column, text: Column) -> Column:
    """An assistant's "can't find" without a hedge in the 80 characters after it."""
    phrase = F.regexp_extract(text, "(?is)" + RECALL_FAILURE, 0)
    at = F.instr(text, phrase)
    tail = F.substring(text, at + F.length(phrase), F.lit(80))
    return F.coalesce((role == "assistant") & (phrase != "") & ~hits(tail, HEDGE), F.lit(False))


def should_ingest(text: Column, role: Column, tool_prefix: str = "memory_") -> Column:
    """Whether a message is worth storing: long enough, no heartbeat, no tool call, no pure
    acknowledgement.  ``tool_prefix``: name prefix of the memory tools themselves."""
    t = F.trim(F.coalesce(text, F.lit("")))
    short = F.length(t)
    noise = [
        short < 15, t.startswith("Conversation info") & (short < 300), t.startswith("Sender (untrusted") & (short < 100), t.rlike(r"^System:\s*\[") & (short < 300), hits(t, "HEARTBEAT_OK"), hits(t, r"Read HEARTBEAT\.md"), hits(t, r"^Read \w+\.md if it exists"),
        (role == "user") & hits(t, rf"^(use|run|call|execute)\s+(the\s+)?{tool_prefix}"), (role == "assistant") & (F.length(F.trim(F.regexp_replace(t, r"\[Tool call: [^\]]+\]\s*", ""))) < 30),
        hits(t, r"^System: \[\d{4}-\d{2}-\d{2}.*gateway (dis)?connected"), hits(t, r"^(ok|okay|sure|yes|no|yep|nope|thanks|thank you|got it|done|lol|haha|hmm|ah|oh)\s*[.!]?$"),
    ]
    return ~F.coalesce(reduce(lambda a, b: a | b, noise), F.lit(False))


def entities(text: Column) -> Column:
    """People, technologies and projects named in a text, first-seen order, original case."""
    t = F.coalesce(text, F.lit(""))
    people = F.filter(F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in PERSONS])), lambda p: ~F.split(p, r"\s")[0].isin(*NOT_PERSONS))
    tech = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit("(?i)" + p), F.lit(1)) for p in TECHNOLOGIES]))
    projects = F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in PROJECTS]))
    return F.array_distinct(F.concat(people, tech, projects))


# --- further fixed values: person cues, analyser lexicon, cue stop words, abstention, relative days -------

PERSON_CUES = (
    (0.9, r"(?:(?:tell|told|ask|asked|ping|cc|dm|email|emailed)\s+|@)([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"),
    (0.7, r"(?:with|from|by)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)(?=\s+(?:said|says|thinks|mentioned|suggested|wants|wanted|is|was|will|can|and|or|,|\.))"),
    (0.8, r"([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\s+(?:said|says|told|mentioned|suggested|asked|thinks|wants|wrote|replied)"),
)
NOT_FIRST_NAMES = (
    "I You He She It We They Me Him Her Us Them My Your His Its Our Their Mine Yours Hers Ours Theirs Someone Somebody Anyone Anybody Everyone Everybody Nobody One Ones"
    " The This That These Those What How Why When Where Who Which There Here Some Any Each Every Both All Most Many Much More Other Another Such Same Good Great Best New Old First Last Next Previous Note"
    " True False Yes No Maybe None Nothing And But Or So If Then Because Although While As Now Just Also Still Is Was Are Were Will Would Should Could May Might Must Do Does Did Have Has Had Be Been Being"
    " Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April June July August September October November December Today Yesterday Tomorrow Morning Afternoon Evening Night"
    " Project Session Work Code Agent Server Client Task Context Action System Status Phase Stage Build Deploy Update Summary Error Item Items Not About After Before During Through"
).split()
ANALYSER_SIGNALS = (
    (0.95, r"\b(remember this|important|note:)\b"), (0.90, r"\b(let'?s go with|we decided|the plan is)\b"), (0.85, r"\b(no actually|that'?s wrong|not like that)\b"), (0.85, r"\b(i prefer|i always|i never)\b"), (0.80, r"\b(frustrated|critical|urgent|excited)\b"),
)
CUE_STOP = "the and for are but not you all can was this that have with from they been has will its our let did how what who why when where".split()
QUESTION_STOP = "what when where which about know remember tell show does last recent that this with from have been the and for are but not you all can was how who why".split()
REPEAT_STOP = "this that with have from they will been were said each which their there what about would make like into time more very when come just than then some could other".split()
ABSTENTIONS = [r"\bi don'?t know\b", r"\bno (?:such )?information\b", r"\bnot (?:mentioned|available|provided|specified)\b", r"\bcannot (?:determine|find|answer)\b"]
RELATIVE_DAYS = (("yesterday", 1), ("last week", 7), ("last month", 30), ("last year", 365), ("two years ago", 730), ("a year ago", 365), ("a month ago", 30), ("a week ago", 7), ("recently", 7))


def persons(text: Column) -> Column:
    """array<struct<name, confidence>>: people by cue, the best confidence a name; full names score
    0.05 more, at most 0.95."""
    found = []
    for base, pattern in PERSON_CUES:
        names = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
        found.append(F.transform(names, _rated(base)))
    every = F.filter(F.flatten(F.array(*found)), lambda p: (F.length(p["name"]) > 1) & ~F.exists(F.split(p["name"], r"\s+"), lambda w: w.isin(*NOT_FIRST_NAMES)))
    distinct = F.array_distinct(F.transform(every, lambda p: p["name"]))
    return F.transform(distinct, lambda n: F.struct(n.alias("name"), F.array_max(F.transform(F.filter(every, lambda p: p["name"] == n), lambda p: p["confidence"])).alias("confidence")))


def _rated(base: float):
    def rate(name: Column) -> Column:
        name = F.trim(name)
        score = F.when(F.contains(name, F.lit(" ")), min(0.95, base + 0.05)).otherwise(base)
        return F.struct(name.alias("name"), score.alias("confidence"))

    return rate


def analyser_salience(text: Column) -> Column:
    """The intent analyser's salience: one signal a family, short acknowledgements count 0.1."""
    t = F.coalesce(text, F.lit(""))
    signals = [F.when(hits(t, p), F.lit(w)) for w, p in ANALYSER_SIGNALS]
    signals += [F.when(F.trim(t).endswith("?"), 0.60), F.when(F.contains(t, F.lit("```")), 0.50), F.when(F.length(t) > 200, 0.40), F.when(hits(t, r"\b(ok|okay|thanks|sure)\b") & (F.length(t) < 20), 0.10)]
    found = F.array_compact(F.array(*signals))
    return F.when(F.size(found) == 0, 0.30).otherwise(F.least(F.lit(0.99), F.array_max(found) + 0.05 * (F.size(found) - 1)))


def cues(text: Column) -> Column:
    """The first eight words of three letters and more that are not stop words."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s,;:.!?()\[\]{}\"']+")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*CUE_STOP)), 1, 8)


def query_variants(text: Column, intent_: Column) -> Column:
    """The query itself, without its question prefix, and by intent without pronouns or as keywords."""
    content = F.trim(F.regexp_replace(F.regexp_replace(text, r"(?i)^(what|who|where|when|why|how|which|do you|did we|can you|tell me|show me)\s+(was|is|are|were|about|know|remember)\s*", ""), r"\?$", ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?i)\b(did|do|we|i|you)\b", ""), r"\?$", ""), r"\s{2,}", " "))
    keywords = F.array_join(F.filter(F.split(F.regexp_replace(text, r"\?$", ""), r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(*QUESTION_STOP)), " ")
    return F.array_distinct(F.array_compact(F.array(text, F.when(F.length(content) > 5, content), F.when((intent_ == "RECALL_EXPLICIT") & (F.length(bare) > 5), bare), F.when((intent_ == "QUESTION") & (keywords != ""), keywords))))


def repeats(text: Column, recent: Column) -> Column:
    """Whether three or more recent texts share a word of more than four letters with this one."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: (F.length(w) > 4) & ~w.isin(*REPEAT_STOP))
    shared = F.filter(recent, lambda r: F.exists(words, lambda w: F.contains(F.lower(r), w)))
    return F.coalesce(F.size(shared) >= 3, F.lit(False))


def abstention(answer: Column) -> Column:
    a = F.trim(F.coalesce(answer, F.lit("")))
    return any_hit(F.substring(a, 1, 120), ABSTENTIONS) & (F.length(a) < 240)


def numeric_gold(gold: Column) -> Column:
    return F.coalesce(gold.rlike(r"^\s*\d+"), F.lit(False))


def gold_in_context(gold: Column, retrieved: Column, n: int) -> Column:
    return (F.size(gold) > 0) & (F.size(F.array_except(gold, F.slice(retrieved, 1, n))) == 0)


def recall_structure(category: Column, ability: Column, text: Column, gold: Column) -> Column:
    """lookup, multi_hop, temporal or aggregation: by category, then ability, then heuristics."""
    a = F.lower(F.coalesce(ability, F.lit("")))
    has = lambda w: F.contains(a, F.lit(w))
    by_category = F.when(category == 2, "multi_hop").when(category == 3, "temporal").when(category.isin(1, 4, 5), "lookup")
    by_ability = F.when(has("temporal"), "temporal").when(has("multi_session") | has("multi-session") | has("knowledge_update"), "multi_hop").when(has("information_extraction") | has("abstention"), "lookup")
    by_rule = F.when(F.size(gold) >= 3, "aggregation").when(any_hit(text, TEMPORAL), "temporal").when(F.size(gold) >= 2, "multi_hop").otherwise("lookup")
    return F.coalesce(by_category, by_ability, by_rule)


def resolve_relative_days(text: Column, said_at: Column) -> Column:
    """Relative dates followed by the day they mean, counted from when they were said."""
    out = text
    for phrase, days in RELATIVE_DAYS:
        day = F.date_format(said_at - F.expr(f"interval {days} days"), "MMMM dd, yyyy")
        put = F.concat(F.lit("$1$2 (approximately "), day, F.lit(")"))
        out = F.regexp_replace(out, F.lit(rf"(?is)^(.*?)\b({phrase})\b"), put)
    return F.coalesce(out, text)
