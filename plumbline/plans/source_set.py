"""Files of a small repository, one per row; ``@N`` is replaced by a name from the tables.

Each detector finds hits here and near-misses that must stay silent.
"""

from __future__ import annotations

TEMPLATES: list[tuple[str, str]] = [
    ("app/__init__.py", ""),
    (
        "app/main.py",
        "import logging\nimport requests\nfrom fastapi import FastAPI\nfrom app import db\nfrom app.tasks import jobs\n\n"
        "class Handler:\n    def get(self):\n        return db.fetch('@N')\n\ndef get():\n    return 1\n\ndef only_@N():\n    return jobs\n",
    ),
    (
        "app/db.py",
        "import sqlalchemy\nimport redis\n\nclass Store:\n    def fetch(self, key):\n"
        "        return f\"SELECT @N FROM t WHERE id = {key}\"\n\n    def close(self):\n        pass\n",
    ),
    ("app/tasks/__init__.py", ""),
    (
        "app/tasks/jobs.py",
        "from ..db import Store\nimport celery\n\nSEEN = 0\n\ndef run_@N():\n    global SEEN\n    try:\n        return Store()\n"
        "    except Exception:\n        return []\n",
    ),
    ("app/settings.py", "import numpy\nimport acme_sdk\nINCLUDE = [\"app.tasks.jobs\", \"not.a.module\", \"@N\"]\n"),
    ("app/broken.py", "def (:\n"),
    (
        "app/narrow.py",
        "import os\n\ndef go_@N(q):\n    try:\n        q.run(\"SELECT a FROM b WHERE id = %s\", (1,))\n    except ValueError:\n"
        "        return None\n    except Exception:\n        raise\n\ndef say(n):\n    return f\"select {n} things from the list\"\n",
    ),
    (
        "web/src/api.ts",
        "import axios from 'axios';\nimport { db } from './db.js';\nexport class Client {\n  load(id: string): string {\n"
        "    try {\n      return fetch(\"/x/@N\");\n    } catch (e) {\n      return [];\n    }\n  }\n}\n",
    ),
    (
        "web/src/db.ts",
        "import { x } from './util';\nconst fs = require('node:fs');\nexport function q(id: string) {\n"
        "  const raw = readFileSync('@N');\n  return run(`SELECT a FROM t WHERE id = ${id}`);\n}\n",
    ),
    (
        "web/src/util/index.ts",
        "export function x() {\n  makeSync(1);\n  return repo.fetch('@N'); // fetch(\"/row\")\n}\n",
    ),
    (
        "web/src/quiet.ts",
        "import { x } from '../src/util/index';\nexport function y() {\n  const q = \"SELECT a \" + \"FROM t \" + \"WHERE id = ?\";\n"
        "  try {\n    go(q);\n  } catch (e) {\n    if (e) { log(e); }\n    throw e;\n  }\n}\n",
    ),
    (
        "svc/worker.go",
        "package svc\n\nimport (\n\t\"database/sql\"\n\t\"net/http\"\n)\n\ntype Worker struct{}\n\nfunc (w *Worker) Run_@N() {\n"
        "\tgo func() {\n\t\tn, _ := atoi(\"1\")\n\t\tuse(n)\n\t}()\n}\n",
    ),
    (
        "svc/quiet.go",
        "package svc\n\nimport \"fmt\"\n\n// go func( describes a call\nfunc Quiet() {\n\t_, err := read()\n"
        "\tfor _, v := range xs {\n\t\tfmt.Println(v, err, \"@N readFileSync(\")\n\t}\n}\n",
    ),
    (
        "core/lib.rs",
        "use tokio::spawn;\nuse std::sync::{Arc, Mutex};\n\npub struct Pool_@N {}\n\npub fn open() {\n"
        "    let v = unsafe { read() };\n    let m = Arc::new(v);\n    m.get().unwrap();\n}\n",
    ),
    ("core/safe.rs", "use std::collections::HashMap;\n\nfn ok() -> Option<u8> {\n    let @N = read()?;\n    Some(@N)\n}\n"),
    (
        "java/Pool.java",
        "package p;\nimport java.util.concurrent.Executor;\nimport java.sql.*;\n\npublic class Pool {\n"
        "  public Object take(String @N) {\n    synchronized (this) {\n      try {\n        return new ProcessBuilder(@N);\n"
        "      } catch (Exception e) {\n        return null;\n      }\n    }\n  }\n}\n",
    ),
    (
        "java/Quiet.java",
        "package p;\nimport java.util.List;\n\npublic class Quiet {\n  public Object find(String @N) {\n    try {\n"
        "      return q(\"SELECT a FROM t WHERE id = ?\");\n    } catch (IOException e) {\n      return null;\n    }\n  }\n}\n",
    ),
    (
        "native/copy.cpp",
        "#include <thread>\n#include \"local/@N.h\"\n\nclass Copier {\n};\n\nvoid run(char *d, char *s) {\n"
        "  std::thread t;\n  try {\n    strcpy(d, s);\n  } catch (...) {\n  }\n}\n",
    ),
    ("native/safe.cpp", "#include <cstring>\n\nvoid put(char *d) {\n  snprintf(d, 4, \"@N\");\n  memcpy(d, d, 1);\n}\n"),
    (
        "Dockerfile",
        "# image of @N\nFROM python\nRUN pip install \\\n    -r requirements.txt\nCOPY --chown=1 . /app\nEXPOSE 8080/tcp\n"
        "CMD gunicorn app \\\n  --workers $((2 * $(nproc) + 1))\n",
    ),
    (
        "docker/Dockerfile.api",
        "ARG BASE=python:3.13-slim\nFROM ${BASE} AS builder\nUSER root\nFROM builder\nFROM registry.local:5000/@N AS last\n"
        "USER app:app\nHEALTHCHECK CMD curl localhost\nENTRYPOINT [\"serve\", \"--workers\", \"$(os.cpus().length)\"]\n",
    ),
    (
        "docker-compose.yml",
        "services:\n  api:\n    build: ./backend\n    command: gunicorn app --workers 4\n    ports:\n      - \"8000:8000\"\n"
        "    environment:\n      POOL_SIZE: 10\n      MAX_OVERFLOW: 5\n    deploy:\n      replicas: 2\n    depends_on:\n      - db\n"
        "  worker:\n    build:\n      context: .\n    command: celery -A app.tasks.jobs worker --concurrency=4 -Q @N\n"
        "    mem_limit: 1g\n  db:\n    image: postgres\n  cache:\n    image: redis:latest\n    ports: [\"6379\"]\n"
        "    healthcheck:\n      test: ping\nvolumes:\n  data:\n    external: true\n",
    ),
    ("Procfile", "# @N\nweb: gunicorn app --workers $(nproc)\nworker: celery -A app\n"),
    (
        ".github/workflows/ci.yml",
        "name: @N\non: push\njobs:\n  test:\n    runs-on: x\n    steps:\n      - uses: actions/checkout\n      - run: pytest -q\n",
    ),
    (
        ".github/workflows/soft.yml",
        "on: [pull_request]\njobs:\n  test:\n    steps:\n      - run: npm test\n        continue-on-error: true\n",
    ),
    (
        ".github/workflows/lost.yml",
        "on:\n  pull_request:\njobs:\n  test:\n    steps:\n      - run: echo @N\n      - run: pytest || true\n",
    ),
    (
        ".github/workflows/good.yml",
        "on:\n  pull_request:\n  push:\njobs:\n  test:\n    steps:\n      - run: make check\n",
    ),
    ("package.json", "{\"name\": \"@N\"}\n"),
    ("web/pyproject.toml", "[project]\nname = \"@N\"\n"),
    ("web/uv.lock", "version = 1\n"),
    ("requirements.txt", "# pins\nSQLAlchemy==2.0.1\nredis>=5.2 ; python_version > '3'\n-r other.txt\n@N[extra]==1.2.3\nunpinned_one\n"),
    ("requirements-dev.txt", "redis==4.0\npytest\n"),
    (
        "pyproject.toml",
        "[project]\nname = \"x\"\ndependencies = [\"sqlalchemy==2.1.0\", \"httpx\"]\n[project.optional-dependencies]\ndev = [\"ruff==0.5.0\"]\n",
    ),
    (
        "alembic/versions/a1.py",
        "from alembic import op\nimport sqlalchemy as sa\n\ndef upgrade():\n    op.create_table('fresh_@N', sa.Column('id', sa.Integer()))\n"
        "    op.add_column('fresh_@N', sa.Column('a', sa.Text(), nullable=False))\n"
        "    op.add_column('users', sa.Column('b', sa.Text(), nullable=False))\n"
        "    op.create_index('ix', 'users', ['b', 'c'], postgresql_concurrently=True)\n\n"
        "def downgrade():\n    op.drop_column('users', 'b')\n",
    ),
    (
        "migrations/m2.py",
        "from alembic import op\n\ndef upgrade():\n    op.create_foreign_key('fk', 'orders', 'users', ['user_id', 'b'], ['id', 'b'])\n"
        "    op.drop_column('orders', '@N')\n    op.create_index('ix2', 'orders', ['b'])\n",
    ),
    (
        "k8s/deploy.yaml",
        "apiVersion: apps/v1\nkind: Deployment\nmetadata:\n  name: @N\nspec:\n  replicas: 3\n  template:\n    spec:\n      containers:\n"
        "        - name: app\n          resources:\n            limits:\n              memory: 1Gi\n          livenessProbe:\n            path: /\n"
        "---\napiVersion: v1\nkind: Service\nmetadata:\n  name: front\n",
    ),
    ("deploy/ordered.conf", "worker_processes 4;\nhttp {\n  keepalive_timeout 5s;\n  upstream @N { keepalive_timeout 9s; }\n}\n"),
    ("deploy/primary.conf", "listen_addresses = '*'\nmax_connections = 40 # @N\n"),
    (".env.example", "API_KEY=\n# SENTRY_DSN=\n# a note\nexport DEBUG=1\n@N=x\n"),
    ("gunicorn.conf.py", "workers = 2\nif x:\n    workers = 3  # more\ntimeout = '30'\n"),
    ("infra/main.tf", "resource \"@N\" {}\n"),
    (".env", "API_KEY=live-@N\n"),
    ("go.mod", "module @N\n"),
]
