"""What a repository shows to the outside, and which findings lie there."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keywords of paths that face outwards, parts of paths and ends of names that never do, and signs of a route in code.
OUTWARD = ["external", "public", "internet-facing", "edge", "dmz", "webhook", "gateway"]
OUTWARD_NAMES = ["external", "gateway", "edge", "webhook", "dmz"]
PUBLIC_KEYS = ["public_key", "publickey", "public-key", "public.key", "public.pem"]
PRIVATE_PARTS = ["tests", "test", "fixtures", "mock", "mocks", "prisma", "migrations", "scripts", "tools", "internal"]
PRIVATE_ENDS = [".db", ".sqlite", ".sqlite3", ".sql", ".prisma", ".lock", ".log"]
INTERNAL_FOLDERS = ["/tests/", "/test/", "/fixtures/", "/mocks/", "/scripts/", "/tools/", "/migrations/", "/internal/"]
ROUTES = [
    ("express route", r"app\.(get|post|put|delete|patch|use)\s*\("), ("express router", r"router\.(get|post|put|delete|use)\s*\("), ("express definition", r"express\.router\b"), ("flask route", r"@app\.route\b"), ("django rest", r"@api_view\b"),
    ("django urls", r"urlpatterns\s*="), ("django path", r"\bre_path\s*\("), ("spring controller", r"@restcontroller\b"), ("spring mapping", r"@(requestmapping|getmapping|postmapping|putmapping|deletemapping)\b"), ("net verb", r"\[http(get|post|put|delete|patch)\]"),
    ("net route", r"\[route\s*\("), ("net controller", r"controllerbase\b"), ("go handler", r"http\.handlefunc\b"), ("gin route", r"gin\.(default|new|engine)\b|\.(get|post)\(\""), ("echo route", r"echo\.(get|post)\b"),
]
LOCAL_HOSTS = ["localhost", "127.0.0.1", "_"]
PROXY_FILE = r"(^|/)(caddyfile[^/]*|[^/]*\.caddy|haproxy\.(cfg|conf)|nginx[^/]*|httpd\.conf|apache2\.conf|[^/]*(haproxy|envoy|traefik)[^/]*)$|sites-(enabled|available)|(nginx|apache|httpd|proxy|web|server).*\.conf$"


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _group(pattern: str) -> Column:
    """What the line holds by a pattern, in lower case and without quotes; null if nothing."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_extract("text", pattern, 1), "[\"']", "")), F.lit(""))


def exposure_surface(lines: DataFrame) -> DataFrame:
    """Exposed services and folders per repository, from lines (repo_id, file, line, text): (repo_id, kind, name).

    Compose services that publish ports; folders and labels of container files
    that expose one; cluster services of an outward type and what an ingress
    leads to; folders and resources of infrastructure that is open to all; and
    names and upstreams of web servers that listen. Names count with dashes
    and underscores alike. The largest group is one file.
    """
    low = lines.withColumns({"path": F.lower("file"), "folder": _folder(F.col("file"))})
    base = F.element_at(F.split("path", "/"), -1)
    order = Window.partitionBy("repo_id", "file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    name = lambda rows, c: rows.where(c.isNotNull()).select("repo_id", F.lit("service").alias("kind"), c.alias("name"))
    folder = lambda rows: rows.where("folder <> ''").select("repo_id", F.lit("folder").alias("kind"), F.col("folder").alias("name"))

    compose = low.where(base.contains("compose")).withColumn("service", F.last(_group(r"^  ([a-zA-Z0-9_-]+):\s*$"), ignorenulls=True).over(order))
    port = F.col("text").rlike(r"^\s*-\s*[\"']?[0-9]+:[0-9]+") | F.col("text").rlike(r"ports\s*:\s*\[[^\]]+\]")
    published = compose.where(port & F.col("service").isNotNull()).select("repo_id", "file", "service").distinct()
    builds = compose.join(published.hint("merge"), ["repo_id", "file", "service"], "left_semi").withColumn("folder", F.regexp_replace(F.coalesce(_group(r"^\s*(?:build|context)\s*:\s*(\S+)"), F.lit("")), r"^[./]+|/+$", ""))

    docker = low.where(base.contains("dockerfile"))
    exposes = docker.where(F.col("text").rlike(r"(?i)^\s*EXPOSE\s+[0-9]"))

    k8s = low.where(base.rlike(r"\.ya?ml$")).withColumn("doc", F.count_if(F.col("text").rlike(r"^---\s*$")).over(order))
    named = F.min_by(_group(r"^\s+name\s*:\s*(\S+)"), F.when(F.col("text").rlike(r"^\s+name\s*:"), F.col("line")))
    documents = k8s.groupBy("repo_id", "file", "folder", "doc").agg(
        F.max(_group(r"^kind\s*:\s*(\S+)")).alias("what"), named.alias("own"), F.bool_or(F.col("text").rlike(r"type\s*:\s*(LoadBalancer|NodePort)")).alias("outward"), F.collect_set(_group(r"(?:serviceName|service)\s*:\s*(\S+)")).alias("backends")
    )
    outward, ingress = documents.where("what = 'service' and outward"), documents.where("what = 'ingress'")

    terraform = low.where(base.endswith(".tf"))
    everyone = r"(?i)(cidr_blocks|source_ranges)\s*=\s*\[[^\]]*(0\.0\.0\.0/0|::/0)|source_address_prefix\s*=\s*[\"']?\*"
    opened = terraform.where(F.col("text").rlike(everyone)).select("repo_id", "file", "folder").distinct()
    resource = F.regexp_replace(_group(r"resource\s+\"[^\"]+\"\s+\"([^\"]+)\""), "[_-](sg|tg|lb|alb|nlb|group|rule|asg)$", "")

    proxy = low.where(F.col("path").rlike(PROXY_FILE))
    listens = proxy.where(F.col("text").rlike(r"(?i)\b(listen|bind)\s+[^\s;]+|<(VirtualHost|Location)|\b(reverse_proxy|frontend|entryPoints|routers|listeners)\b")).select("repo_id", "file", "folder").distinct()
    served = proxy.join(listens.select("repo_id", "file").hint("merge"), ["repo_id", "file"], "left_semi")
    hosts = served.select("repo_id", F.explode(F.split(F.coalesce(_group(r"(?i)server_name\s+([^;]+);"), F.lit("")), r"\s+")).alias("host")).where((F.col("host") != "") & ~F.col("host").isin(*LOCAL_HOSTS)).select("repo_id", F.lit("service").alias("kind"), F.split("host", r"\.")[0].alias("name"))
    upstream = F.coalesce(_group(r"(?i)proxy_pass\s+https?://([a-z0-9_-]+)"), _group(r"(?i)reverse_proxy\s+([a-z0-9_-]+)"), _group(r"(?i)server\s+([a-z0-9_-]+)\s+[0-9.:]+"))

    parts = [
        name(published, F.col("service")), folder(builds), folder(exposes), name(docker, _group(r"(?i)LABEL\s+service\s*=\s*(\S+)")),
        name(outward, F.col("own")), folder(outward), folder(ingress), name(ingress.select("repo_id", F.explode("backends").alias("b")), F.col("b")),
        folder(opened), name(terraform.join(opened.select("repo_id", "file").hint("merge"), ["repo_id", "file"], "left_semi"), resource), folder(listens), hosts, name(served.where(~F.coalesce(upstream, F.lit("")).isin(*LOCAL_HOSTS)), upstream),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    variants = F.when(F.col("kind") == "service", F.array("name", F.replace("name", F.lit("-"), F.lit("_")), F.replace("name", F.lit("_"), F.lit("-")))).otherwise(F.array("name"))
    return rows.select("repo_id", "kind", F.explode(variants).alias("name")).distinct()


def classify_exposure(findings: DataFrame, surface: DataFrame | None = None, keys: Sequence[str] = ("repo_id",)) -> DataFrame:
    """Findings with exposure and why: private artefacts are internal, then what the surface shows, then keywords of the path, else internal.

    ``surface`` is that of exposure_surface. Paths meet it by their parts and
    by their folders, once for each distinct path of a repository, and read it
    once. No side is sent whole to all tasks: names repeat, so a table that is
    small as it is shuffled may be large in the driver.
    """
    path = F.regexp_replace(F.col("file"), r"\\", "/")
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    private = F.exists(F.array(*map(F.lit, PRIVATE_ENDS)), lambda e: name.endswith(e)) | name.rlike(r"^\.env(\..*)?$") | F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, PRIVATE_PARTS)))
    word = F.lit(None).cast("string")
    for w in reversed(OUTWARD):
        found = low.rlike(r"(^|/)public/|[-_]public|public[-_]") & ~any_of(low, PUBLIC_KEYS) if w == "public" else low.contains(w)
        word = F.when(found, w).otherwise(word)
    paths = findings.select(*keys, "file").distinct()
    service = folder = F.lit(None).cast("string")
    if surface is not None:
        stems = F.transform(F.split(low, "/"), lambda p: F.regexp_replace(p, r"\.[^.]*$", ""))
        variants = F.array_distinct(F.concat(F.split(low, "/"), stems, F.transform(stems, lambda s: F.replace(s, F.lit("_"), F.lit("-"))), F.transform(stems, lambda s: F.replace(s, F.lit("-"), F.lit("_")))))
        above = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda i: F.array_join(F.slice(F.split(path, "/"), 1, i), "/"))
        of = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
        asked = paths.select(*keys, "file", F.explode(F.concat(of("service", variants), of("folder", above))).alias("n")).select(*keys, "file", "n.*")
        shown = asked.join(surface.hint("merge"), [*keys, "kind", "name"]).groupBy(*keys, "file").agg(*[F.min(F.when(F.col("kind") == kind, F.col("name"))).alias(f"_{kind}") for kind in ("service", "folder")])
        paths = paths.join(shown.hint("merge"), [*keys, "file"], "left")
        service, folder = F.col("_service"), F.col("_folder")
    hidden = private & ~any_of(name, OUTWARD_NAMES)
    why = F.when(hidden, "private artefact").when(service.isNotNull(), F.concat(F.lit("service:"), service)).when(folder.isNotNull(), F.concat(F.lit("folder:"), folder)).when(word.isNotNull(), F.concat(F.lit("keyword:"), word)).otherwise("no sign")
    told = paths.withColumn("exposure_reason", why).withColumn("exposure", F.when(F.col("exposure_reason").rlike("^(service|folder|keyword):"), "external-facing").otherwise("internal"))
    return findings.drop("exposure").join(told.select(*keys, "file", "exposure", "exposure_reason").hint("merge"), [*keys, "file"])


def classify_exposure_scored(findings: DataFrame, imported_by_public: Column | None = None) -> DataFrame:
    """Findings with exposure_label, exposure_score (1 to 5), exposure_confidence and exposure_signals.

    A stated class decides; files that are internal by kind come next; then
    signs add up: a route in the code, what a deployment says, an import from a
    public controller, the address that is bound, and words of the path.
    """
    file = F.lower(F.coalesce("file", F.lit("")))
    text = F.lower(F.concat_ws(" ", "file", "algorithm", "code_snippet"))
    any_of = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    stated = F.lower(F.coalesce("exposure", F.lit("")))
    internal_kind = (file.rlike(r"\.(db|sqlite|sqlite3)$") | any_of(file, INTERNAL_FOLDERS)) & ~any_of(file, ["edge", "gateway", "dmz", "webhook"])
    route = F.coalesce(*[F.when(text.rlike(p), n) for n, p in ROUTES])
    deploys = any_of(text, ["dockerfile", "docker-compose", "compose.y", "ingress", "nginx", "haproxy", "caddyfile"])
    outward = text.rlike(r"expose\s+[0-9]+|listen\s+[0-9]+") | any_of(text, ["loadbalancer", "nodeport", "ingress"])
    inward = any_of(text, ["clusterip", "internal-only", "private-net"])
    deployed = F.when(deploys & outward, "public deployment").when(deploys & inward, "internal deployment")
    imported = F.lit(False) if imported_by_public is None else F.coalesce(imported_by_public, F.lit(False))
    binding = F.when(any_of(text, ["0.0.0.0", "*:8080", 'http.listenandserve(":8080"', "server.listen(8080"]), "public binding").when(any_of(text, ["127.0.0.1", "localhost", "unix:"]), "loopback binding")
    keyword = F.when(any_of(file, [w for w in OUTWARD if w != "public"]), "outward path").when(any_of(file, [*INTERNAL_FOLDERS, "/spec/", "/dev/", "/jobs/", "/cron/"]), "internal path")

    s1 = F.greatest(F.when(route.isNotNull(), 5.0).otherwise(0.0), F.when(deployed == "public deployment", 5.0).when(deployed == "internal deployment", 1.0).otherwise(0.0), F.when(imported, 4.5).otherwise(0.0))
    marked = findings.withColumns({"_route": route, "_deployed": deployed, "_imported": F.when(imported, "public import"), "_binding": binding, "_keyword": keyword, "_s": s1})
    s = F.col("_s")
    bound = F.when(F.col("_binding") == "public binding", F.when(s == 0, 4.0).otherwise(F.least(F.lit(5.0), s + 0.5))).when(F.col("_binding") == "loopback binding", F.when(s == 0, 1.0).otherwise(F.greatest(F.lit(1.0), s - 1.0))).otherwise(s)
    marked = marked.withColumn("_b", bound)
    total = F.when(F.col("_b") > 0, F.col("_b")).otherwise(F.when(F.col("_keyword") == "outward path", 4.0).otherwise(1.0))
    sure = F.when(F.col("_route").isNotNull() | F.col("_deployed").isNotNull(), "High").when(F.col("_imported").isNotNull() | F.col("_binding").isNotNull() | ((F.col("_b") == 0) & (F.col("_keyword") == "outward path")), "Medium").otherwise("Low")
    signals = F.array_compact(F.array("_route", "_deployed", "_imported", "_binding", "_keyword"))
    of = lambda label, score, confidence, sign: F.struct(label.alias("exposure_label"), score.alias("exposure_score"), confidence.alias("exposure_confidence"), sign.alias("exposure_signals"))
    fixed = lambda label, score, sign: of(F.lit(label), F.lit(score), F.lit("High"), F.array(F.lit(sign)))
    weighed = of(F.when(total >= 4, "External").otherwise("Internal"), F.round(total, 1), sure, F.when(F.size(signals) == 0, F.array(F.lit("no sign"))).otherwise(signals))
    told = F.when(stated == "internal", fixed("Internal", 1.0, "stated")).when(stated.isin("external", "external-facing"), fixed("External", 5.0, "stated")).when(internal_kind, fixed("Internal", 1.0, "internal file")).otherwise(weighed)
    kept = [c for c in findings.columns if c not in ("exposure_label", "exposure_score", "exposure_confidence", "exposure_signals")]
    return marked.withColumn("_told", told).select(*kept, "_told.*")
