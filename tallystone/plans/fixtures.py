"""Small embedded projects, so that operators on source trees can run where there are none."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tree

FILES = {
    "shop": {
        "main.py": 'from flask import Flask\nimport requests\nimport os\nfrom shop import database\n\napp = Flask(__name__)\nSECRET_KEY = os.getenv("SECRET_KEY")\n\n\n@app.route("/orders", methods=["GET", "POST"])\ndef orders():\n    """Orders."""\n    if os.environ["DEBUG"] or SECRET_KEY:\n        requests.post("http://localhost:5000/pay/7")\n    return database.all()\n',
        "shop/__init__.py": "",
        "shop/database.py": "import sqlalchemy\nfrom shop import cart\n\nengine = sqlalchemy.create_engine('sqlite://')\n\n\ndef all():\n    return [x for x in engine if x]  # TODO page\n",
        "shop/cart.py": "from shop import database\nimport shop.missing\n\n\nclass Cart:\n    def total(self):\n        while True:\n            return eval(self.rule)\n",
        "tests/test_shop.py": "import shop\n\n\ndef test_shop():\n    assert shop\n",
        "requirements.txt": "flask==3.0\nrequests>=2\nsqlalchemy\n",
        ".env": "SECRET_KEY=abc\nDEBUG=1\n",
        "docker-compose.yml": "services:\n  web:\n    build: .\n    depends_on:\n      db:\n        condition: service_healthy\n    environment:\n      - DATABASE_URL=postgres://db:5432\n  db:\n    image: postgres\n",
    },
    "token": {
        "contracts/Token.sol": "pragma solidity ^0.8.0;\ncontract Token is Base {\n  Exchange public exchange;\n  function mint(uint a) public { require(tx.origin == msg.sender); exchange.list(a); }\n}\n",
        "contracts/Exchange.sol": "contract Exchange {\n  Token private token;\n  constructor(address a) { token = Token(a); base = new Base(); }\n  function list(uint a) public {}\n}\ncontract Base {\n}\n",
        "backend/app.js": "const express = require('express');\nconst r = require('./routes/api');\nconst app = express();\nconst port = process.env.PORT || 3000;\napp.get('/api/tokens/:id', (q, s) => s.json(eval(q.body)));\n",
        "backend/routes/api.js": "module.exports = {};\n",
        "frontend/src/App.js": "import x from './x';\nfetch('/api/tokens/7');\n",
        "frontend/src/x.js": "export default 1;\n",
        "package.json": '{"dependencies": {"express": "^4.0.0"}, "devDependencies": {"hardhat": "*"}}',
    },
}


def files(spark: SparkSession) -> DataFrame:
    rows = [(p, path, path.split("/")[:-1], os.path.basename(path), os.path.splitext(path)[1] if not os.path.basename(path).startswith(".") else "", len(text), text) for p, own in FILES.items() for path, text in own.items()]
    return spark.createDataFrame(rows, tree.SCHEMA).withColumn("lang", tree.language(F.col("ext")))
