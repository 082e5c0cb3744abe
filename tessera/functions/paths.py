"""Column expressions over repository paths: kinds, roles, stems, prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import Rules, either, extension, filename, matches, under

# Conventions of repositories that decide a file's category.
ENVIRONMENT: Rules = [
    ("name_starts", (".env", "dockerfile", "docker-compose", "pulumi.", "build.gradle", "tsconfig", "webpack.", "vite.", "rollup.", "esbuild.", "babel.")),
    ("name_ends", (".env", ".snk", ".pfx", ".pem", ".tf", ".tfvars", ".csproj", ".mk")),
    ("name_has", (".helmrelease.",)),
    ("name", (
        ".dockerignore", ".gitlab-ci.yml", "jenkinsfile", ".travis.yml", "azure-pipelines.yml", "bitbucket-pipelines.yml",
        "package.json", "cargo.toml", "go.mod", "go.sum", "requirements.txt", "pipfile", "pyproject.toml", "gemfile", "pom.xml",
        "package.swift", "build.sbt", "composer.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock",
        "gemfile.lock", "poetry.lock", "composer.lock", "makefile", "cmakelists.txt", "build.rs", ".mcp.json", ".tool-versions",
        ".nvmrc", ".node-version", ".python-version", ".ruby-version", ".gitignore", ".gitattributes", ".gitmodules", "codeowners",
    )),
    ("path_has", (
        ".github/workflows/", ".circleci/", ".changeset/", ".changes/", "k8s/", "kubernetes/", "helm/", "terraform/", "pulumi/",
        "cdk/", "cloudformation/", ".vscode/", ".idea/", ".eclipse/", ".mcp/",
    )),
]
APPLICATION_CONFIG: Rules = [("name", ("application.properties",))]
SCHEMAS: Rules = [*under("schemas", "schema", "types"), ("name_has", (".schema.", ".dto."))]
MIGRATIONS: Rules = [*under("migrations", "migrate", "seeds", "fixtures"), ("name_has", (".migration.",))]
SCRIPTS: Rules = [("ext", ("sh", "bash", "zsh", "ps1")), *under("scripts")]
DEPLOYMENT: Rules = under("deploy", "deployment")
DOCUMENT_EXTENSIONS = ("md", "mdx", "rst", "txt")
DOCUMENTS: Rules = [("ext", DOCUMENT_EXTENSIONS), *under("docs", "documentation")]
SITE_CONTENT: Rules = [("path_starts", ("docs/content/", "content/", "www/docs/"))]
INLINE_DOCUMENT_PLACES: Rules = [("path_has", ("/src/docs/", "/resources/mdtest/"))]
LINT: Rules = [
    ("name_starts", (".eslint", ".prettier", ".stylelint")),
    ("name", (".editorconfig", ".clang-format", "rustfmt.toml", ".rubocop.yml", ".flake8", "mypy.ini", ".golangci.yml")),
]
TEST_UTILITIES: Rules = [("path_has", ("/test-utils/", "/test-helpers/", "/__fixtures__/", "/test/fixtures/", "/testutils/"))]
GENERATED: Rules = [("path_has", ("/generated/", "/__generated__/")), ("name_has", (".generated.",)), ("name_ends", (".g.dart", ".pb.go"))]
CONFIG_LIKE: Rules = [
    ("name", (
        "settings.py", "celeryconf.py", "urls.py", "wsgi.py", "asgi.py", "conftest.py", "manage.py", "setup.py", "setup.cfg",
        "rector.php", "phpstan.neon", "phpunit.xml", "phpunit.xml.dist", "version.go", "version.ts", "version.js", "version.py",
        "version.rb", "__version__.py", "version_current.go", "config.ts", "config.js", "config.mjs", "config.py", "config.go",
        "config.rs", "config.rb", "config.php", "config.java", "config.kt", "config.cs", "config.swift", "config.scala",
        "settings.ts", "settings.js", "seed.ts", "seed.js", "biome.json", "build.ts", "build.js", "build.mjs",
    )),
    ("name_starts", ("zz_generated",)),
    ("name_has", (".config.",)),
    ("name_ends", (".proto", ".pb.go")),
    ("path_has", ("/swagger/", "/openapi/", "/pkg/brew/", "/vendor/", "/third_party/", "/migrations/")),
    ("path_starts", ("scripts/", "pkg/brew/", "vendor/", "third_party/", "node_modules/")),
]
ROOT_DOCUMENTS: Rules = [("name", (
    "readme.md", "changelog.md", "changelog.rst", "contributing.md", "license.md", "security.md", "authors.md",
    "code_of_conduct.md", "changes.rst", "history.md", "releases.md",
))]
ANYWHERE_DOCUMENTS: Rules = [("name", ("readme.md", "changelog.md", "changelog.rst"))]
API_PAGES = ("docs/api.md", "docs/api.mdx", "docs/api.rst", "docs/api.txt")
LANDING_SECTIONS = ("docs/user/", "docs/community/")
TEST_MARKS = (".test.", ".spec.", ".vitest.", "_test.", ".e2e.", ".integration-test.", "_bench_test.")
TEST_FILES: Rules = [
    ("name_has", TEST_MARKS),
    ("name_starts", ("test_",)),
    ("path_has", ("/tests/", "/test/", "/__tests__/", "/testscripts/", "/testdata/", "/specs/")),
    ("path_starts", ("tests/", "test/", "testscripts/", "specs/")),
]
ROLES = [
    ("Handler", ("handler", "controller", "route")),
    ("Service", ("service",)),
    ("Repository", ("repo", "repository", "dal")),
    ("Model", ("model", "schema", "entity")),
    ("Config", ("config", "setting")),
    ("Test", ("test", "spec")),
    ("Utility", ("util", "helper", "lib")),
]
CATEGORY_LABELS = {
    "Infrastructure": "Infrastructure", "Schema": "Schemas", "Script": "Scripts", "Migration": "Migrations",
    "Deployment": "Deployment", "Documentation": "Documentation", "Lint": "Lint", "TestUtil": "Test utilities",
    "Generated": "Generated", "DirectoryGroup": "Directory group", "Unclassified": "Unclassified",
}
CATEGORY_SLUGS = {
    "Infrastructure": "infrastructure", "Schema": "schema", "Script": "script", "Migration": "migration",
    "Deployment": "deployment", "Documentation": "documentation", "Lint": "lint", "TestUtil": "test-util",
    "Generated": "generated", "DirectoryGroup": "directory-group", "Unclassified": "unclassified",
}
RISK: dict[str, Rules] = {
    "is_schema": [("path_has", ("schema", "migration")), ("path_ends", (".sql",))],
    "is_auth": [("path_has", ("auth", "security", "permission", "rbac", "acl"))],
    "is_api": [("path_has", ("api/", "routes/", "handlers/", "endpoints/"))],
    "is_test": [("path_has", (".test.", ".spec.", "__tests__")), ("path_starts", ("test/", "tests/"))],
}
COMMON_STEMS = ("package", "changelog", "readme", "license", "index", "mod", "lib", "main", "init", "__init__", "version", "setup", "config", "tsconfig")
GENERIC_TOPICS = (
    "docs", "doc", "documentation", "content", "tutorial", "tutorials", "guide", "guides", "reference", "references", "advanced",
    "example", "examples", "sample", "samples", "site", "www", "src", "test", "tests", "resources", "mdtest", "how", "with", "and",
)
SOURCE_EXTENSIONS = (
    "go", "rs", "ts", "tsx", "js", "jsx", "py", "java", "kt", "rb", "php", "cs", "swift", "scala", "vue", "svelte", "tmpl", "html",
    "css", "scss", "md", "mdx", "rst", "c", "h", "cc", "cpp", "cxx", "hh", "hpp",
)
FIXTURE_EXTENSIONS = (
    "go", "rs", "ts", "tsx", "js", "jsx", "py", "java", "kt", "rb", "php", "cs", "swift", "scala", "vue", "svelte", "astro", "c", "h",
    "cc", "cpp", "cxx", "hh", "hpp",
)
NATIVE_EXTENSIONS = ("c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "h++")
CONTAINERS = ("services", "workers", "libs", "modules", "packages", "features", "domains", "core", "shared", "ui")
MONOREPO_ROOTS = ("apps", "packages", "services", "workers", "libs", "modules", "crates")
FIXTURE_CONFIGS = (".gitignore", "package.json", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "turbo.json")
SEMANTIC_DOCS: Rules = [
    ("path_has", ("/src/docs/", "/resources/mdtest/", "/docs_src/")),
    ("path_starts", ("docs_src/", "docs/tutorial/", "docs/advanced/", "docs/how-to/", "docs/guide/", "docs/guides/", "docs/reference/")),
]
FALLBACK_DOCS: Rules = [
    *under("documentation/docs", "www/docs", "content/docs", "site/content"),
    ("path_starts", ("docs/tutorial/", "docs/advanced/")),
]
LANGUAGES = {
    "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "py": "Python", "pyi": "Python", "go": "Go", "rs": "Rust", "java": "Java", "cs": "CSharp", "php": "Php", "rb": "Ruby",
    "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "c++": "Cpp", "hpp": "Cpp", "h++": "Cpp",
    "hxx": "Cpp", "hh": "Cpp", "scala": "Scala", "sc": "Scala",
}


def lookup(value: Column, names: dict[str, str]) -> Column:
    """The name under a key, null for other keys."""
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[value]


def is_true_infrastructure(path: Column) -> Column:
    return matches(path, ENVIRONMENT)


def is_config_like(path: Column) -> Column:
    """Configuration under a source extension."""
    theme = matches(path, [("path_has", ("/themes/",))]) & matches(path, [("name_starts", ("theme-",))])
    fixture = F.lower(path).contains("/fixtures/") & ~F.lower(path).contains("/src/")
    return matches(path, CONFIG_LIKE) | theme | fixture


def is_landing_page(path: Column, section: str) -> Column:
    lower = F.lower(path)
    rest = F.substring(lower, len(section) + 1, 1 << 20)
    return lower.startswith(section) & ~rest.contains("/") & F.substring_index(rest, ".", -1).isin(*DOCUMENT_EXTENSIONS)


def is_top_level_doc(path: Column) -> Column:
    at_root = ~path.contains("/")
    return F.lower(path).isin(*API_PAGES) | either(*[is_landing_page(path, s) for s in LANDING_SECTIONS]) | (at_root & matches(path, ROOT_DOCUMENTS)) | matches(path, ANYWHERE_DOCUMENTS)


def category(path: Column) -> Column:
    """The first category whose conventions a path meets, else Unclassified."""
    lower = F.lower(path)
    database = filename(lower).endswith(".sql") & (lower.contains("/resources/db/") | lower.startswith("db/"))
    inline = extension(lower).isin("md", "mdx") & matches(path, INLINE_DOCUMENT_PLACES)
    document = ~matches(path, SITE_CONTENT) & ~inline & matches(path, DOCUMENTS)
    cascade = [
        ("Infrastructure", matches(path, ENVIRONMENT + APPLICATION_CONFIG)),
        ("Migration", database),
        ("Schema", matches(path, SCHEMAS)),
        ("Migration", matches(path, MIGRATIONS)),
        ("Script", matches(path, SCRIPTS)),
        ("Deployment", matches(path, DEPLOYMENT)),
        ("Documentation", document),
        ("Lint", matches(path, LINT)),
        ("TestUtil", matches(path, TEST_UTILITIES)),
        ("Generated", matches(path, GENERATED)),
    ]
    out = F.when(cascade[0][1], cascade[0][0])
    for name, condition in cascade[1:]:
        out = out.when(condition, name)
    return out.otherwise("Unclassified")


def is_classified(path: Column) -> Column:
    return ~category(path).isin("Unclassified", "DirectoryGroup")


def role(path: Column) -> Column:
    """The first role whose words a path contains, else Infrastructure."""
    lower = F.lower(path)
    out = F.when(F.lit(False), "")
    for name, words in ROLES:
        out = out.when(either(*[lower.contains(w) for w in words]), name)
    return out.otherwise("Infrastructure")


def is_test_file(path: Column) -> Column:
    name = filename(F.lower(path))
    stem = _without_extension(name)
    return matches(path, TEST_FILES) | stem.endswith("test") | stem.endswith("tests") | stem.endswith("spec")


def risk_flags(path: Column) -> dict[str, Column]:
    return {name: matches(path, rules) for name, rules in RISK.items()}


def language(path: Column) -> Column:
    """Programming language by the extension as it is written, else Unknown."""
    return F.coalesce(lookup(F.substring_index(path, ".", -1), LANGUAGES), F.lit("Unknown"))


def has_source_extension(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*SOURCE_EXTENSIONS)


def is_native_source(path: Column) -> Column:
    return F.lower(F.substring_index(path, ".", -1)).isin(*NATIVE_EXTENSIONS)


def _without_extension(name: Column) -> Column:
    """What precedes the last dot; the whole name without one."""
    return F.regexp_replace(name, r"(?s)\.[^.]*$", "")


def _without_marks(name: Column, marks: tuple[str, ...]) -> Column:
    for mark in marks:
        name = F.replace(name, F.lit(mark), F.lit("."))
    return name


def bare_stem(path: Column) -> Column:
    """File name without test marks and extension, lower-case; empty for names that many packages share."""
    stem = _without_extension(_without_marks(filename(path), TEST_MARKS[:-1]))
    stem = F.lower(F.regexp_replace(stem, "^test_", ""))
    stem = F.regexp_replace(stem, "(?:tests|test|spec)$", "")
    return F.when(stem.isin(*COMMON_STEMS), "").otherwise(stem)


def contextual_stem(path: Column) -> Column:
    """Last two directories and the stem that a test and what it tests share."""
    stem = _without_extension(_without_marks(filename(path), TEST_MARKS))
    stem = F.regexp_replace(F.regexp_replace(stem, "^test_", ""), "(?:Tests|Test|Spec)$", "")
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    context = F.slice(folders, F.greatest(F.size(folders) - 1, F.lit(1)), 2)
    return F.concat(F.array_join(context, "/"), F.lit(":"), stem)


def parent_directory(path: Column, root: str | None = None) -> Column:
    """Directory of a path; `root` where it has none."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(root))


def file_stem(path: Column) -> Column:
    """File name up to its first dot."""
    return F.substring_index(filename(path), ".", 1)


def directory_prefix(path: Column, depth: int) -> Column:
    """The first `depth` directories, null where a path has fewer; depth 0 is for files at the root."""
    if depth == 0:
        return F.when(~path.contains("/"), F.lit(""))
    parts = F.split(path, "/")
    return F.when(F.size(parts) > depth, F.array_join(F.slice(parts, 1, depth), "/"))


def normalize(path: Column) -> Column:
    """`.` and empty segments dropped, `..` resolved as far as there is a parent."""

    def walk(done: Column, segment: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(segment.isin(".", ""), done).when(segment == "..", up).otherwise(F.concat(done, F.array(segment)))

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), walk), "/")


def dotted_to_path(source: Column) -> Column:
    """A relative import with leading dots as a path: one dot the own directory, each more one up."""
    dots = F.length(F.regexp_extract(source, r"^\.*", 0))
    rest = F.regexp_replace(source, r"^\.+", "")
    up = F.when(dots == 1, ".").otherwise(F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/"))
    return F.when(dots == 0, source).when(rest == "", up).otherwise(F.concat(up, F.lit("/"), F.replace(rest, F.lit("."), F.lit("/"))))


def topic_tokens(path: Column) -> Column:
    """Distinct words of the stem and of the three nearest directories that say something of the topic."""
    folders = F.split(F.lower(parent_directory(path, "")), "/")
    near = F.reverse(F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), 3))
    pieces = F.flatten(F.transform(F.concat(F.array(bare_stem(path)), near), lambda s: F.split(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "), " ")))
    words = F.transform(pieces, lambda w: F.regexp_replace(w, "^[0-9]+", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_TOPICS)))


def short_label(path: Column) -> Column:
    """Last two segments."""
    return F.substring_index(path, "/", -2)


def node_label(i: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA, and so on through two letters."""
    letter = F.char(F.lit(65) + i % 26)
    return F.when(i < 26, letter).otherwise(F.concat(F.char(F.lit(64) + F.floor(i / 26)), letter))


def partition_key(path: Column) -> Column:
    """Coarse bucket of a file in a very large change set: `infra:` or `semantic:` and a key."""
    parts = F.split(path, "/")
    first, second, third = (F.get(parts, F.lit(i)) for i in range(3))
    plain = lambda s: s.isNotNull() & ~s.contains(".")
    deep = plain(second) & plain(third) & second.isin(*CONTAINERS)
    semantic = (
        F.when(first == "", "root")
        .when(first.isin(*MONOREPO_ROOTS) & deep, F.concat_ws("/", first, second, third))
        .when(first.isin(*MONOREPO_ROOTS) & plain(second), F.concat_ws("/", first, second))
        .otherwise(first)
    )
    return (
        F.when(is_config_like(path), "infra:config-like")
        .when(is_classified(path), F.concat(F.lit("infra:"), lookup(category(path), CATEGORY_SLUGS)))
        .otherwise(F.concat(F.lit("semantic:"), semantic))
    )


def fixture_root(path: Column) -> Column:
    """Path through the first segment below a `fixtures` directory, null without one."""
    root = F.regexp_extract(path, r"(?i)^((?:.*?/)?fixtures/[^/]+)/", 1)
    alone = F.regexp_extract(path, r"(?i)^((?:.*?/)?fixtures)/[^/]+$", 1)
    return F.when(root != "", root).when(alone != "", alone)


def is_fixture_source(path: Column) -> Column:
    return fixture_root(path).isNotNull() & F.lower(F.substring_index(path, ".", -1)).isin(*FIXTURE_EXTENSIONS)


def is_fixture_config(path: Column) -> Column:
    name = filename(F.lower(path))
    return fixture_root(path).isNotNull() & (name.isin(*FIXTURE_CONFIGS) | (name.startswith("tsconfig") & name.endswith(".json")))


def is_localized_docs(path: Column) -> Column:
    return F.lower(path).rlike(r"^docs/[a-z-]{2,8}/docs/")


def is_root_docs_page(path: Column) -> Column:
    """A page directly in docs/ that is no landing page."""
    return ~is_top_level_doc(path) & F.lower(path).rlike(r"^docs/[^/]*$") & F.substring_index(F.lower(path), ".", -1).isin(*DOCUMENT_EXTENSIONS)


def is_fallback_doc(path: Column, root_pages: Column) -> Column:
    return matches(path, FALLBACK_DOCS) | (is_root_docs_page(path) & (root_pages >= 3))


def is_semantic_doc(path: Column, root_pages: Column) -> Column:
    """Documentation that belongs to code; `root_pages` counts the root pages of the change set."""
    page = F.substring_index(F.lower(path), ".", -1).isin(*DOCUMENT_EXTENSIONS) & ~is_top_level_doc(path) & ~is_localized_docs(path)
    return page & (matches(path, SEMANTIC_DOCS) | is_fallback_doc(path, root_pages))
