"""Pull requests, issues, releases and CI runs of a code-hosting service, page by page to the last one.

``spark.read.format("hosted_project").option("repo", "owner/name").option("kind", "issue")``.
Further options: ``api`` (address), ``token``, ``readers`` (partitions, 10), ``per_page`` (50), ``state`` (all).
Reader i of n takes pages i, i + n, i + 2n and so on until one is not full; comments are read to their last page too.
Kind ``pr_graphql`` asks the GraphQL interface for merged pull requests, one page after the other.
A request waits out the service's rate limit.  Rows have the layout of their kind's records.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from annalist import schemas

_PATHS = {"pr": "pulls", "issue": "issues", "release": "releases", "cicd": "actions/runs"}


_MERGED = """query Merged($size: Int!, $after: String, $name: String!, $owner: String!) {
  repository(name: $name, owner: $owner) {
    pullRequests(after: $after, first: $size, orderBy: {direction: DESC, field: UPDATED_AT}, states: MERGED) {
      nodes {
        closingIssuesReferences(first: 5) { nodes { title number } }
        author { login }
        mergedAt createdAt body: bodyText title number
      }
      pageInfo { endCursor hasNextPage }
    }
  }
}"""


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


def row_of(kind: str, item: dict) -> tuple | None:
    """A record of ``kind`` from the service's answer; None for an issue that is a pull request."""
    who = lambda x: (x or {}).get("login") or ""
    if kind == "pr":
        return (
            item["number"], item.get("title") or "", item.get("body") or "", item.get("state"), who(item.get("user")),
            item.get("created_at"), item.get("updated_at"), item.get("closed_at"), item.get("merged_at"),
            item.get("merge_commit_sha"), [x["name"] for x in item.get("labels", [])],
            [c.get("body") or "" for c in item.get("review_comments_data", [])],
        )
    if kind == "issue":
        if item.get("pull_request"):
            return None
        return (
            item["number"], item.get("title") or "", item.get("body") or "", item.get("state"), who(item.get("user")),
            item.get("created_at"), item.get("updated_at"), item.get("closed_at"),
            [x["name"] for x in item.get("labels", [])], [c.get("body") or "" for c in item.get("comments_data", [])], None,
        )
    if kind == "pr_graphql":
        closing = ((item.get("closingIssuesReferences") or {}).get("nodes") or [])[:5]
        return (
            item["number"], item.get("title") or "", item.get("body") or "", who(item.get("author")), item.get("createdAt"),
            item.get("mergedAt"), [f"#{x['number']}: {x.get('title') or ''}" for x in closing],
        )
    if kind == "release":
        tag = item.get("tag_name") or ""
        return tag, tag, item.get("name") or "", item.get("body") or "", item.get("created_at"), item.get("published_at"), None
    return (
        item["id"], item.get("name") or "", item.get("status") or "", item.get("conclusion"), item.get("created_at"),
        item.get("updated_at"), item.get("html_url") or "", item.get("event") or "", item.get("head_branch") or "",
        who(item.get("actor")),
    )


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = dict(options)
        self.kind = self.o["kind"]

    def partitions(self) -> list[InputPartition]:
        return [_Page(i + 1) for i in range(1 if self.kind == "pr_graphql" else int(self.o.get("readers", 10)))]

    def _get(self, path: str, body: dict | None = None) -> object:
        address = f"{self.o.get('api', 'https://api.github.com').rstrip('/')}/{path}"
        headers = {"Accept": "application/json"} | ({"Authorization": f"Bearer {self.o['token']}"} if self.o.get("token") else {})
        data = None if body is None else json.dumps(body).encode()
        with urllib.request.urlopen(urllib.request.Request(address, data, headers), timeout=60) as answer:
            if int(answer.headers.get("X-RateLimit-Remaining") or 2) <= 1:
                time.sleep(max(0, int(answer.headers.get("X-RateLimit-Reset") or 0) - time.time()) + 1)
            return json.load(answer)

    def _pages(self, path: str, first: int = 1, step: int = 1) -> Iterator[dict]:
        size, page = int(self.o.get("per_page", 50)), first
        while True:
            mark = "&" if "?" in path else "?"
            found = self._get(f"repos/{self.o['repo']}/{path}{mark}per_page={size}&page={page}")
            found = found["workflow_runs"] if isinstance(found, dict) else found
            yield from found
            if len(found) < size:
                return
            page += step

    def _merged(self) -> Iterator[dict]:
        owner, name = self.o["repo"].split("/")
        after = None
        while True:
            given = {"owner": owner, "name": name, "size": int(self.o.get("per_page", 50)), "after": after}
            found = self._get("graphql", {"query": _MERGED, "variables": given})["data"]["repository"]["pullRequests"]
            yield from found["nodes"]
            if not found["pageInfo"]["hasNextPage"]:
                return
            after = found["pageInfo"]["endCursor"]

    def read(self, partition: _Page) -> Iterator[tuple]:
        if self.kind == "pr_graphql":
            items = self._merged()
        else:
            step = int(self.o.get("readers", 10))
            items = self._pages(f"{_PATHS[self.kind]}?state={self.o.get('state', 'all')}", partition.number, step)
        for item in items:
            if self.kind == "pr":
                item["review_comments_data"] = list(self._pages(f"pulls/{item['number']}/comments"))
            elif self.kind == "issue" and not item.get("pull_request") and item.get("comments"):
                item["comments_data"] = list(self._pages(f"issues/{item['number']}/comments"))
            if (row := row_of(self.kind, item)) is not None:
                yield row


class HostedProject(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hosted_project"

    def schema(self) -> str:
        return schemas.PAYLOADS[self.options["kind"]][0]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HostedProject)
