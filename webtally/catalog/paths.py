"""Well-known sensitive URL paths and static file suffixes."""

from __future__ import annotations

# The paths a stored URL is compared with (substring test).
SENSITIVE_PATHS: list[str] = [
    "/robots.txt",
    "/sitemap.xml",
    "/.env",
    "/.env.local",
    "/.env.development",
    "/.env.production",
    "/.env.staging",
    "/.env.bak",
    "/.env.old",
    "/.env.example",
    "/config.json",
    "/config.yml",
    "/config.yaml",
    "/manifest.json",
    "/package.json",
    "/package-lock.json",
    "/composer.json",
    "/composer.lock",
    "/yarn.lock",
    "/swagger.json",
    "/swagger.yaml",
    "/swagger-ui.html",
    "/swagger-ui/",
    "/openapi.json",
    "/openapi.yaml",
    "/api-docs",
    "/api-docs/swagger.json",
    "/redoc",
    "/graphql",
    "/graphiql",
    "/playground",
    "/altair",
    "/__graphql",
    "/api/v1",
    "/api/v2",
    "/api/v3",
    "/api/docs",
    "/api/schema",
    "/.git/config",
    "/.git/HEAD",
    "/.git/index",
    "/.gitignore",
    "/.svn/entries",
    "/.svn/wc.db",
    "/.hg/store",
    "/.bzr/README",
    "/.DS_Store",
    "/webpack-stats.json",
    "/stats.json",
    "/build-info.json",
    "/asset-manifest.json",
    "/precache-manifest.json",
    "/service-worker.js",
    "/sw.js",
    "/workbox-*.js",
    "/actuator",
    "/actuator/env",
    "/actuator/health",
    "/actuator/info",
    "/actuator/metrics",
    "/actuator/mappings",
    "/actuator/beans",
    "/actuator/configprops",
    "/actuator/heapdump",
    "/actuator/threaddump",
    "/actuator/loggers",
    "/actuator/httptrace",
    "/actuator/scheduledtasks",
    "/actuator/caches",
    "/actuator/conditions",
    "/health",
    "/info",
    "/metrics",
    "/env",
    "/debug",
    "/console",
    "/debug/default/view",
    "/_debug_toolbar/",
    "/_debugbar/open",
    "/_profiler/",
    "/elmah.axd",
    "/trace.axd",
    "/phpinfo.php",
    "/info.php",
    "/server-status",
    "/server-info",
    "/.well-known/openid-configuration",
    "/admin",
    "/admin/",
    "/administrator",
    "/wp-admin",
    "/wp-login.php",
    "/wp-config.php.bak",
    "/wp-config.php.old",
    "/wp-config.php.orig",
    "/wp-config.php~",
    "/wp-json/wp/v2/users",
    "/.htaccess",
    "/.htpasswd",
    "/web.config",
    "/crossdomain.xml",
    "/clientaccesspolicy.xml",
    "/security.txt",
    "/.well-known/security.txt",
    "/humans.txt",
    "/backup.sql",
    "/backup.zip",
    "/backup.tar.gz",
    "/db.sql",
    "/database.sql",
    "/dump.sql",
    "/.backup",
    "/node_modules/.package-lock.json",
    "/.npmrc",
    "/.yarnrc",
    "/.babelrc",
    "/tsconfig.json",
    "/next.config.js",
    "/nuxt.config.js",
    "/vite.config.js",
    "/vue.config.js",
    "/angular.json",
    "/Dockerfile",
    "/docker-compose.yml",
    "/docker-compose.yaml",
    "/.dockerenv",
    "/.gitlab-ci.yml",
    "/.github/workflows/",
    "/Jenkinsfile",
    "/.circleci/config.yml",
    "/404",
    "/500",
    "/error",
    "/errors",
]

# Suffixes (without dot) that mark a reference as a text asset.
STATIC_EXTENSIONS: list[str] = [
    "js",
    "mjs",
    "cjs",
    "jsx",
    "ts",
    "tsx",
    "json",
    "xml",
    "yaml",
    "yml",
    "toml",
    "html",
    "htm",
    "svg",
    "map",
    "env",
    "config",
    "conf",
    "txt",
    "md",
]

# Path suffixes a link traversal never follows.
UNFOLLOWED_SUFFIXES: list[str] = [
    ".js",
    ".css",
    ".png",
    ".jpg",
    ".jpeg",
    ".gif",
    ".svg",
    ".ico",
    ".woff",
    ".woff2",
    ".ttf",
    ".eot",
    ".pdf",
    ".zip",
    ".gz",
    ".mp3",
    ".mp4",
    ".webm",
    ".ogg",
    ".wav",
]

# Substrings of a lower-cased URL a link traversal never follows.
UNFOLLOWED_SUBSTRINGS: list[str] = [
    "/wp-content/", "/wp-includes/", "/node_modules/",
    "javascript:", "mailto:", "tel:", "data:", "#", "void(0)",
]

# Content types that are never text assets.
BINARY_CONTENT_TYPES: list[str] = ["image/", "font/", "audio/", "video/", "octet-stream"]

# Markers of client-side rendering frameworks.
FRAMEWORK_MARKERS: list[str] = [
    "react", "ReactDOM", "__NEXT_DATA__", "__next",
    "ng-app", "ng-version", "angular",
    "Vue", "__vue__", "__VUE__", "createApp",
    "nuxt", "__nuxt", "__NUXT__",
    "svelte", "SvelteKit", "ember",
]
