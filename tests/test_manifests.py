"""Manifests of all four kinds, folded in the order in which they are read."""

import json

from cartolake.functions.project_xml import references
from cartolake.operators import correlate
from cartolake.operators.manifests import manifest_facts, manifest_packages, manifest_summary, read_manifests

PROPS = '<Project><ItemGroup><PackageVersion Include="Microsoft.AspNetCore.OpenApi" /><PackageReference Include="Acme.Central" /></ItemGroup></Project>'
FILES = [
    ("all", "package.json", '{"name": "web", "dependencies": {"left-pad": "1"}}'),
    ("all", "a/A.csproj", '<Project Sdk="Microsoft.NET.Sdk"><PackageReference Include="Acme.One" /></Project>'),
    ("all", "Directory.Packages.props", PROPS),
    ("all", "p/pyproject.toml", 'name = "tool"\nnumpy>=1\n'),
    ("all", "f/F.fsproj", '<Project><PackageReference Include="Acme.Sharp" /></Project>'),
    ("cs", "Directory.Packages.props", PROPS),
    ("cs", "src/B.csproj", '<Project><PackageReference Update="Hangfire.Core" /></Project>'),
    ("hosted", "DIRECTORY.packages.PROPS", '<Project><PackageReference Include="microsoft.aspnetcore.App" /></Project>'),
    ("props", "Directory.Packages.props", PROPS),
    ("py", "pyproject.toml", 'name = "tool"\nnumpy>=1\n'),
]


def test_four_kinds(spark):
    files = spark.createDataFrame([("w", *f) for f in FILES], "workspace_id string, repo_id string, path string, text string")
    read = read_manifests(files)
    assert {(r.repo_id, r.path) for r in read.collect()} == {(r, p) for r, p, _ in FILES if not p.endswith(".fsproj")}
    assert read_manifests(files.where("repo_id = 'all'"), 4).count() == 4
    packages = {(r.repo_id, r.package) for r in correlate.manifest_packages(read).collect()}
    assert {p for r, p in packages if r == "all"} == {"left-pad", "Acme.One", "Acme.Central", "name", "numpy"} and ("props", "Acme.Central") in packages
    assert {r.repo_id: r.kind for r in correlate.classify_repo_kind(read).collect()} == {"all": "library", "cs": "worker", "hosted": "backend", "props": "unknown", "py": "library"}
    named = {r.repo_id: (r.name, r.language) for r in correlate.repo_name_language(read).collect()}
    assert named["all"] == ("web", "javascript") and named["cs"] == ("B", "csharp") and named["py"] == ("tool", "python")
    assert named["props"] == ("Directory.Packages", "csharp")  # only the stem "Directory" gives no name


def folded(spark, files, **limits):
    df = spark.createDataFrame([("w", "r", *f) for f in files], "workspace_id string, repo_id string, path string, text string")
    facts = manifest_facts(read_manifests(df))
    return manifest_summary(facts, **limits).first(), [r.package for r in manifest_packages(facts, **limits).collect()]


def npm(name=None, **sections):
    return json.dumps(({"name": name} if name else {}) | sections)


WEB, PLAIN = '<Project Sdk="Microsoft.NET.Sdk.Web" />', '<Project Sdk="Microsoft.NET.Sdk" />'


def test_order_of_kinds(spark):
    """Each manifest sees the kind so far: package.json first, then project files."""
    kind = lambda *files: folded(spark, files)[0].kind
    assert kind(("z/package.json", npm(dependencies={"React-Native": "1"})), ("a/A.csproj", WEB)) == "backend"
    assert kind(("z/package.json", npm(scripts={"start": "Node server.js"})), ("a/A.csproj", PLAIN)) == "backend"
    assert kind(("package.json", npm(dependencies={"foo": "1.0.0-next.1"}))) == "unknown"
    assert kind(("package.json", npm(dependencies={"angular-ui": "1"}))) == "unknown"
    assert kind(("package.json", npm(devDependencies={"react": "1"}))) == "unknown"
    assert kind(("package.json", npm(dependencies={"@angular/core": "1"}, scripts={"start": "node x"}))) == "frontend"
    assert kind(("a/package.json", npm(dependencies={"vue": "1"})), ("b/package.json", npm(dependencies={"react-native": "1"}))) == "mobile"
    refs = lambda *names, sdk="": f"<Project {sdk}><ItemGroup>" + "".join(f'<PackageReference Include="{n}"/>' for n in names) + "</ItemGroup></Project>"
    assert kind(("A.csproj", refs("Microsoft.Extensions.Hosting", "Microsoft.AspNetCore.App"))) == "worker"
    assert kind(("A.csproj", refs("Microsoft.AspNetCore.App", "Hangfire"))) == "backend"
    assert kind(("A.csproj", refs("Microsoft.Extensions.Hosting", "Microsoft.AspNetCore.App", sdk='Sdk="Microsoft.NET.Sdk"'))) == "backend"
    assert kind(("A.csproj", refs("Hangfire", sdk='Sdk="Microsoft.NET.Sdk"'))) == "library"
    assert kind(("A.csproj", PLAIN), ("B.csproj", refs("microsoft.aspnetcore.x"))) == "backend"
    assert kind(("A.csproj", refs("Hangfire")), ("B.csproj", refs("Microsoft.AspNetCore"))) == "worker"
    assert kind(("A.csproj", "<Project Sdk='X.Worker'>")) == "unknown" and kind(("A.csproj", "<Project Sdk='X.Worker'/>")) == "worker"
    assert kind(("A.csproj", "<Project/>"), ("pyproject.toml", "")) == "library" and kind(("pyproject.toml", None)) == "unknown"


def test_names_and_languages(spark):
    def named(*files):
        out = folded(spark, files)[0]
        return out.name, out.language

    assert named(("a/package.json", '{"name": 5}'), ("b/package.json", npm("second"))) == ("second", "javascript")
    assert named(("package.json", '{"name": ""}'), ("A.csproj", PLAIN)) == ("r", "javascript")
    assert named(("package.json", "{bad"), ("Directory.csproj", PLAIN), ("pyproject.toml", "# name = no\n names = \n  NAME = 'tool' \n")) == ("tool", "csharp")
    assert named(("A.csproj", "no xml")) == ("A", "csharp") and named(("package.json", "[1]")) == ("r", "unknown") and named(("package.json", None)) == ("r", "unknown")
    assert named(("pyproject.toml", 'x = 1\r\nname == "a=b"')) == ("= \"a=b", "python")


def test_folders(spark):
    paths = ["vendor/package.json", "coverage/A.csproj", "target/pyproject.toml", ".config/package.json", "OBJ/package.json", "a/venv/b/pyproject.toml", "bin/A.csproj", "bin.csproj", "a/Dist/package.json", ".next/package.json"]
    df = spark.createDataFrame([("w", "r", p, "") for p in paths], "workspace_id string, repo_id string, path string, text string")
    assert {r.path for r in read_manifests(df).collect()} == {"vendor/package.json", "coverage/A.csproj", "target/pyproject.toml", ".config/package.json", "bin.csproj"}
    assert [r.path for r in read_manifests(df, 2).collect()] == [".config/package.json", "vendor/package.json"]
    assert read_manifests(df, skipped=["vendor"]).count() == 9 and manifest_summary(manifest_facts(read_manifests(df.limit(0)))).count() == 0


def test_most_packages(spark):
    """No manifest is read after the one that takes the packages over their limit."""
    files = [("a/package.json", npm("n", dependencies={f"p{i}": "1" for i in range(4)}, peerDependencies={"P1": "1", "q": "1"})), ("b/package.json", npm(dependencies={"q": "1", "vue": "1"})), ("c/A.csproj", WEB)]
    assert folded(spark, files, most=5)[0].kind == "frontend" and folded(spark, files, most=5)[1] == ["p0", "p1", "p2", "p3", "q"]
    assert folded(spark, files, most=4)[0].kind == "unknown" and folded(spark, files, most=4)[1] == ["p0", "p1", "p2", "p3"]
    assert folded(spark, files)[0].kind == "backend" and len(folded(spark, files)[1]) == 6


def test_references():
    assert references('<Project Sdk="s"><PackageReference Version="1" Include="X.Y" /><C><W><PackageReference Update="Z"/></W></C></Project>') == (True, "s", ["X.Y", "Z"])
    assert references('<P><PackageReference Include="" Update="q"/><PackageReference/></P>') == (True, "", [])
    assert references('<Project xmlns="http://s"><PackageReference Include="X"/></Project>') == (True, "", [])
    assert references("<a/><b/>") == references(None) == references("") == (False, "", [])
