"""Fixed values as the SQL of the plans spells them: written out once more, so that a wrong value in
an operator shows as a difference."""

BACKEND_PATH = "(^|/)(controllers?|services?|routes?|handlers?|api|server|jobs?|workers?|consumers?|repositories?)(/|$)"
BACKEND_WORDS = ("req,", "res,", "ctx.", "router.", "app.get(", "app.post(", "select ", "insert ", "update ", "delete ", "transaction")
CI_PATHS = ("^[.]gitlab-ci[.]yml$", "^[.]gitlab/", "^[.]github/workflows/", "^[.]circleci/", "^[.]buildkite/", "(^|/)(azure-pipelines|bitrise)[.]ya?ml$")
CI_WORDS = (
    "stages:",
    "jobs:",
    "script:",
    "before_script:",
    "after_script:",
    "workflow:",
    "workflow_dispatch",
    "needs:",
    "artifacts:",
    "rules:",
    "only:",
    "except:",
)
CONFIG_ENDINGS = (".json", ".jsonc", ".toml", ".ini", ".conf", ".properties", ".yml", ".yaml")
FRONTEND_PATH = "(^|/)(hooks|store|state|client|ui|web)(/|$)"
FRONTEND_WORDS = ("window.", "document.", "localstorage", "sessionstorage", "navigator.", "queryclient", "usequery(", "usemutation(")
IMPACT = (
    ("access", "(?i)(auth|admin|permission|role|session|token|csrf|signature|verify|tenant)"),
    ("concurrency", "(?i)(transaction|begintransaction|commit|rollback|mutex|lock|for update|version|compareandset|cas)"),
    ("query_scope", r"(?i)\b(where|tenant_id|user_id|owner_id|status|deleted_at|is_deleted|limit)\b"),
    ("guard", r"^\s*(if|throw|return|continue|break|assert|invariant)\b"),
)
REACT_PATH = "(^|/)(components?|pages?|views?|screens|layouts)(/|$)"
REACT_WORDS = ("from 'react'", "from \"react\"", "usestate(", "useeffect(", "usememo(", "usereducer(", "<div", "</")
REMOVED_BEHAVIOUR = (
    ("access", r"\b(auth|permission|role|acl|session|token|tenant)\b"),
    ("concurrency", r"\b(transaction|commit|rollback|lock|mutex|semaphore)\b"),
    ("query_scope", r"\b(where|filter|scope|owner|status|deleted|isactive)\b"),
    ("guard", r"\b(if|else|return|throw|catch|guard|assert|ensure)\b"),
)
STRATEGIES = (
    ("backend_service", 760, 2600, 2200, True, True, True, True, 4, 6, True, 3, 3, 3, 3, 3),
    ("backend_module", 680, 2100, 1400, True, True, True, True, 3, 5, True, 1, 2, 3, 3, 2),
    ("react_component", 700, 2500, 0, True, False, True, True, 3, 5, False, 0, 3, 2, 3, 2),
    ("frontend_module", 640, 2200, 0, True, False, True, True, 2, 4, False, 0, 2, 2, 2, 2),
    ("ci_pipeline", 620, 900, 0, True, False, False, False, 0, 0, False, 0, 0, 0, 0, 0),
    ("app_config", 420, 700, 0, False, False, False, False, 0, 0, False, 0, 0, 0, 0, 0),
    ("test", 520, 1500, 600, True, False, True, True, 2, 4, True, 1, 2, 1, 2, 1),
    ("docs", 260, 400, 0, False, False, False, False, 0, 0, False, 0, 0, 0, 0, 0),
    ("generic", 560, 1500, 800, True, False, True, True, 2, 4, False, 0, 2, 2, 2, 2),
)
TEST_PATHS = ("(^|/)(__tests__|tests?|spec|e2e|fixtures?|mocks?)(/|$)", "[.](spec|test)[.](ts|tsx|js|jsx|mjs|cjs)$")
DEPLOYMENT = (
    "^[.]gitlab-ci[.]ya?ml$",
    "^dockerfile(?:[.][^.]+)?$",
    "(^|/)[.]gitlab/",
    "(^|/)[.]github/workflows/",
    "(^|/)[.]circleci/",
    "(^|/)[.]buildkite/",
    "(^|/)(deploy|deployment|release|runbook|ops|operation|infra|infrastructure|k8s|kubernetes|helm|charts|terraform|tfvars|manifests)(/|[.-])",
    "(^|/)(docker-compose|compose)[.]ya?ml$",
    "(^|/)(azure-pipelines|bitrise)[.]ya?ml$",
    "[.]tf$",
    "[.]tfvars$",
)
HIGH_RISK = ("src/auth/", "src/security/", "src/config/", "[.]env")
IGNORED = (
    "node_modules/",
    "dist/",
    "build/",
    "coverage/",
    "[.]next/",
    "storybook-static/",
    "package-lock[.]json$",
    "yarn[.]lock$",
    "pnpm-lock[.]yaml$",
    "bun[.]lockb$",
    "[.]min[.]js$",
    "[.]min[.]css$",
    "[.]map$",
    "[.]snap$",
    "[.]pdf$",
    "[.]woff$",
    "[.]woff2$",
    "[.]ttf$",
    "[.]eot$",
    "[.]ico$",
    "[.]mp4$",
    "[.]mp3$",
    "[.]zip$",
    "[.]gz$",
    "[.]png$",
    "[.]jpg$",
    "[.]jpeg$",
    "[.]gif$",
    "[.]svg$",
)
SCRIPT_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
NAME_SOURCES = (
    (r"\b([a-z][A-Za-z0-9_$]*)\s*\(", 6),
    (r"\b(?:extends|implements|new|as)\s+([A-Z][A-Za-z0-9_$]*)", 7),
    (r":\s*([A-Z][A-Za-z0-9_$]*)\b", 6),
    (r"<([A-Z][A-Za-z0-9_$]*)\b", 5),
    (r"\b([A-Z][A-Za-z0-9_$]*)\b", 2),
)
STOP_NAMES = (
    "if",
    "for",
    "while",
    "switch",
    "catch",
    "return",
    "await",
    "async",
    "const",
    "let",
    "var",
    "true",
    "false",
    "null",
    "undefined",
    "import",
    "export",
    "from",
    "default",
    "type",
    "new",
    "extends",
    "implements",
    "function",
    "class",
    "interface",
    "console",
)


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)
IMPACT_TEXTS = (
    ("pure_removal", "本次改动是纯删除/收缩型变更，建议重点确认是否移除了必要的校验、兜底或副作用逻辑。"),
    ("access", "本次改动删除了鉴权、权限或租户隔离相关逻辑，建议确认不会放宽访问边界。"),
    ("concurrency", "本次改动删除了事务、锁或版本控制相关逻辑，建议确认并发场景下仍然安全。"),
    ("query_scope", "本次改动删除了查询过滤条件或范围约束，建议确认不会放宽数据读取范围。"),
    ("guard", "本次改动删除了防御性分支或提前返回逻辑，建议确认异常路径和边界条件仍被覆盖。"),
)
ENDINGS = (
    "", ".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".d.ts",
    "/index.ts", "/index.tsx", "/index.mts", "/index.cts", "/index.js", "/index.jsx", "/index.mjs", "/index.cjs", "/index.d.ts",
)
