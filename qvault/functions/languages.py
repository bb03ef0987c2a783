"""Languages of files by path, name, extension, first line and content, with their tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of paths, in the order that decides.
PATHS = [
    (".github/workflows/", "GitHub Actions"), (".gitlab-ci", "GitLab CI"), ("ansible", "Ansible"), ("k8s/", "Kubernetes manifest"), ("kubernetes/", "Kubernetes manifest"), ("helm/", "Helm"), ("charts/", "Helm"),
]
# Whole names of files, as given or in lower case.
NAMES = {
    "Dockerfile": "Dockerfile dockerfile Dockerfile.dev Dockerfile.prod",
    "Makefile": "Makefile makefile GNUmakefile",
    "CMake": "CMakeLists.txt",
    "Dotenv": ".env .envrc",
    "Nginx config": "nginx.conf",
    "Apache config": "httpd.conf apache2.conf .htaccess .htpasswd",
    "OpenSSL config": "openssl.cnf openssl.conf",
    "Docker Compose": "docker-compose.yml docker-compose.yaml compose.yml compose.yaml",
    "Pipfile": "Pipfile Pipfile.lock",
    "pyproject.toml": "poetry.lock pyproject.toml",
    "pip requirements": "requirements.txt",
    "Python": "setup.py setup.cfg",
    "Go module": "go.sum go.mod",
    "Cargo.toml": "Cargo.toml Cargo.lock",
    "Gemfile": "Gemfile Gemfile.lock",
    "composer.json": "composer.json composer.lock",
    "Node (package.json)": "package.json package-lock.json yarn.lock",
    "Maven POM": "pom.xml",
    "Gradle": "build.gradle build.gradle.kts settings.gradle settings.gradle.kts gradlew",
    "Jenkinsfile": "Jenkinsfile",
    "Procfile": "Procfile",
    "Vagrantfile": "Vagrantfile",
    "SSH config": "known_hosts",
    "SSH key": "authorized_keys",
    "npm config": ".npmrc",
    "yarn config": ".yarnrc",
    "Babel config": ".babelrc",
    "Webpack config": "webpack.config.js",
    "Vite config": "vite.config.js vite.config.ts",
}
# Beginnings of names, in the order that decides.
PREFIXES = [("Dockerfile.", "Dockerfile"), ("requirements", "pip requirements"), (".env.", "Dotenv")]
# Extensions, as given or in lower case.
EXTENSIONS = {
    "Python": "py pyw pyi", "JavaScript": "js mjs cjs", "JSX": "jsx", "TypeScript": "ts", "TSX": "tsx", "Java": "java", "Kotlin": "kt kts", "Scala": "scala", "Groovy": "groovy gvy", "Go": "go", "Rust": "rs", "C": "c h",
    "C++": "cc cpp cxx hh hpp", "C#": "cs", "C# project": "csproj", "Visual Basic project": "vbproj", "F# project": "fsproj", "MATLAB": "m", "Objective-C": "mm", "Swift": "swift", "Dart": "dart", "PHP": "php phtml", "Ruby": "rb rake",
    "Perl": "pl pm", "Lua": "lua", "R": "r R", "Julia": "jl", "Haskell": "hs lhs", "Elixir": "ex exs", "Erlang": "erl hrl", "Clojure": "clj cljs cljc", "F#": "fs fsi fsx", "OCaml": "ml mli", "Visual Basic": "vb",
    "Fortran": "f f90 f95 for", "COBOL": "cob cbl", "Pascal/Delphi": "pas pp dpr", "Assembly": "asm s nasm", "Solidity": "sol", "Vyper": "vy", "Zig": "zig", "Nim": "nim", "Crystal": "cr", "PowerShell": "ps1 psm1 psd1",
    "Bash/Shell": "sh bash", "Zsh": "zsh", "Fish shell": "fish", "Batch": "bat cmd", "SQL": "sql", "PL/SQL": "plsql pls pks pkb", "HTML": "html htm", "CSS": "css", "SCSS": "scss", "Sass": "sass", "Less": "less", "Vue": "vue",
    "Svelte": "svelte", "XML": "xml xsl xslt", "Markdown": "md markdown", "reStructuredText": "rst", "JSON": "json json5", "YAML": "yaml yml", "TOML": "toml", "INI": "ini cfg", "Config file": "conf config", "Dotenv": "env",
    "Properties": "properties", "Terraform/HCL": "tf tfvars hcl", "Protobuf": "proto", "GraphQL": "graphql gql", "Makefile": "makefile mk", "Gradle": "gradle", "Certificate": "crt cer pem der", "Private key": "key",
    "PKCS#12": "p12 pfx", "Java Keystore": "jks", "CSR": "csr", "SSH key": "pub",
}
# Interpreters of first lines, in the order that decides where one is only part of the line.
INTERPRETERS = [
    ("python3", "Python"), ("python", "Python"), ("node", "JavaScript"), ("nodejs", "JavaScript"), ("ruby", "Ruby"), ("perl", "Perl"), ("php", "PHP"), ("bash", "Bash/Shell"), ("sh", "Bash/Shell"), ("zsh", "Zsh"), ("fish", "Fish shell"),
    ("lua", "Lua"), ("Rscript", "R"), ("julia", "Julia"), ("groovy", "Groovy"), ("kotlin", "Kotlin"), ("pwsh", "PowerShell"), ("powershell", "PowerShell"),
]
# Patterns of the first 2,000 characters, in the order that decides.
CONTENTS = [
    (r"^-----BEGIN RSA PRIVATE", "Private key"), (r"^-----BEGIN EC PRIVATE", "Private key"), (r"^-----BEGIN OPENSSH", "SSH key"), (r"^-----BEGIN ", "Certificate"), (r"ssh-rsa |ssh-ed25519 |ecdsa-sha2-", "SSH key"),
    (r"^%YAML|^---\n", "YAML"), (r"\{\s*\"", "JSON"), (r"^\[DEFAULT\]|^\[global\]", "INI"), (r"^FROM |^RUN |^COPY |^ENV |^EXPOSE ", "Dockerfile"),
]


def _by(table: dict[str, str]) -> Column:
    """A map from each listed value to its language."""
    return F.create_map(*[F.lit(x) for language, values in table.items() for v in values.split() for x in (v, language)])


def _first(cases: list[tuple[Column, str]]) -> Column:
    return F.coalesce(*[F.when(c, language) for c, language in cases])


def detect_language(path: Column, content: Column) -> Column:
    """By part of the path, name, beginning of the name, extension, first line, then content, the first that knows; else Unknown."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    name = F.element_at(F.split(path, "/"), -1)
    extension = F.regexp_extract(name, r"^\.*[^.]+.*\.([^.]+)$", 1)  # of ".env" the dot is part of the name
    first = F.trim(F.split(content, "\n", 2)[0])
    asked = F.trim(F.replace(F.substring(first, 3, 1 << 20), F.lit("/usr/bin/env"), F.lit("")))
    program = F.element_at(F.split(F.split(asked, r"\s+")[0], "/"), -1)
    bare = F.regexp_replace(program, r"[\d.]+$", "")
    shebang = F.when(first.startswith("#!"), F.coalesce(_first([((bare == k) | (program == k), v) for k, v in INTERPRETERS]), _first([(asked.contains(k), v) for k, v in INTERPRETERS])))
    head = F.substring(content, 1, 2000)
    return F.coalesce(
        _first([(path.contains(k), v) for k, v in PATHS]),
        _by(NAMES)[name], _by(NAMES)[F.lower(name)],
        _first([(name.startswith(k) | F.lower(name).startswith(k.lower()), v) for k, v in PREFIXES]),
        _by(EXTENSIONS)[extension], _by(EXTENSIONS)[F.lower(extension)],
        shebang, _first([(head.rlike("(?m)" + k), v) for k, v in CONTENTS]), F.lit("Unknown"),
    )
