"""The stock rules of the scanner.

Fixed values: identifiers, classes, severities, patterns, languages and suppressors, in the order of their groups.
``{`` is escaped where Java needs it; every pattern is matched without regard to case.
"""

from __future__ import annotations

from .sast import Rule

RULES = [
    Rule('SEC-001', 'CWE-798', 'CRITICAL', 'A07', 'Secrets', 'AWS Access Key ID hardcoded', r"""(?:AKIA|ASIA)[0-9A-Z]{16}""", ('*',), None),
    Rule('SEC-002', 'CWE-798', 'CRITICAL', 'A07', 'Secrets', 'AWS Secret Access Key hardcoded', r"""(?:aws_secret_access_key|secret_key)\s*[=:]\s*['"][A-Za-z0-9/+=]{40}['"]""", ('*',), r"""(?:example|placeholder|xxx|your[-_]?key|CHANGE[-_]?ME)"""),
    Rule('SEC-003', 'CWE-798', 'CRITICAL', 'A07', 'Secrets', 'GitHub token hardcoded', r"""(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9_]{36,}""", ('*',), None),
    Rule('SEC-004', 'CWE-798', 'CRITICAL', 'A07', 'Secrets', 'Private key embedded in source', r"""-----BEGIN\s+(?:RSA\s+|EC\s+|DSA\s+|OPENSSH\s+)?PRIVATE\s+KEY-----""", ('*',), None),
    Rule('SEC-005', 'CWE-798', 'HIGH', 'A07', 'Secrets', 'Generic API key/secret assignment', r"""(?:api[_-]?key|api[_-]?secret|auth[_-]?token|access[_-]?token)\s*[=:]\s*['"][A-Za-z0-9_\-/.+=]{16,}['"]""", ('*',), r"""(?:example|placeholder|xxx|your[-_]?key|CHANGE[-_]?ME|test|fake|dummy|process\.env|os\.environ|os\.getenv)"""),
    Rule('SEC-006', 'CWE-798', 'HIGH', 'A07', 'Secrets', 'Hardcoded password in source', r"""(?:password|passwd|pwd)\s*[=:]\s*['"][^'"]{8,}['"]""", ('*',), r"""(?:example|placeholder|xxx|CHANGE[-_]?ME|test|fake|dummy|\*+|process\.env|os\.environ|os\.getenv|argparse|input\(|getpass)"""),
    Rule('SEC-007', 'CWE-798', 'HIGH', 'A07', 'Secrets', 'Database connection string with credentials', r"""(?:postgresql|mysql|mongodb|redis|amqp)://[^:]+:[^@]+@[^/\s'"]+""", ('*',), r"""(?:localhost|127\.0\.0\.1|example\.com|placeholder|user:pass)"""),
    Rule('SEC-008', 'CWE-798', 'HIGH', 'A07', 'Secrets', 'Slack/Discord/Telegram bot token hardcoded', r"""(?:xox[bpsar]-[A-Za-z0-9-]{10,}|discord[_.]?(?:token|webhook)[^=]*[=:]\s*['"][^'"]{20,}['"]|bot_token\s*[=:]\s*['"][0-9]+:[A-Za-z0-9_-]{35}['"])""", ('*',), None),
    Rule('SEC-009', 'CWE-798', 'HIGH', 'A07', 'Secrets', 'JWT secret hardcoded', r"""(?:jwt[_-]?secret|secret[_-]?key|signing[_-]?key)\s*[=:]\s*['"][A-Za-z0-9_\-/.+=]{16,}['"]""", ('*',), r"""(?:example|placeholder|xxx|CHANGE[-_]?ME|test|fake|process\.env|os\.environ|os\.getenv|your[-_]?secret)"""),
    Rule('SEC-010', 'CWE-312', 'MEDIUM', 'A02', 'Secrets', 'Sensitive data logged or printed', r"""(?:print|log(?:ger)?\.(?:info|debug|warn|error)|console\.log|fmt\.Print)\s*\([^)]*(?:password|secret|token|credential|api[_-]?key)""", ('*',), r"""(?:#|//|/\*)\s*(?:print|log)"""),
    Rule('INJ-001', 'CWE-78', 'CRITICAL', 'A03', 'Injection', 'OS command injection via shell=True', r"""subprocess\.(?:call|run|Popen|check_output|check_call)\s*\([^)]*shell\s*=\s*True""", ('python',), r"""#.*subprocess"""),
    Rule('INJ-002', 'CWE-78', 'CRITICAL', 'A03', 'Injection', 'OS command execution via os.system()', r"""os\.system\s*\(\s*(?:f['"]|[^'"]*\+|[^'"]*\.format|[^'"]*%)""", ('python',), None),
    Rule('INJ-003', 'CWE-95', 'CRITICAL', 'A03', 'Injection', 'Code injection via eval()', r"""\beval\s*\(\s*(?!['"][^'"]*['"]\s*\))""", ('python', 'javascript', 'typescript'), r"""(?:#|//)\s*.*eval"""),
    Rule('INJ-004', 'CWE-95', 'CRITICAL', 'A03', 'Injection', 'Code injection via exec()', r"""\bexec\s*\(\s*(?!['"][^'"]*['"]\s*\))""", ('python',), r"""(?:#|//)\s*.*exec"""),
    Rule('INJ-005', 'CWE-89', 'HIGH', 'A03', 'Injection', 'SQL injection via string formatting', r"""(?:execute|query|raw|cursor\.execute)\s*\(\s*(?:f['"]|[^'"]*\+|[^'"]*\.format|[^'"]*%).*(?:SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE)""", ('python',), None),
    Rule('INJ-006', 'CWE-89', 'HIGH', 'A03', 'Injection', 'SQL injection via string concatenation', r"""(?:query|sql|stmt)\s*(?:=|\+=)\s*['"].*(?:SELECT|INSERT|UPDATE|DELETE|WHERE).*['"]\s*\+""", ('python', 'javascript', 'typescript', 'go'), None),
    Rule('INJ-007', 'CWE-89', 'HIGH', 'A03', 'Injection', 'SQL injection via Go Sprintf in query', r"""(?:db\.(?:Query|Exec|Prepare)|\.(?:Raw|Where|Having|Order))\s*\(\s*fmt\.Sprintf""", ('go',), None),
    Rule('INJ-008', 'CWE-79', 'HIGH', 'A03', 'Injection', 'XSS via innerHTML assignment', r"""\.innerHTML\s*=\s*(?!['"`]\s*$)""", ('javascript', 'typescript'), r"""\.innerHTML\s*=\s*['"`]\s*['"`]"""),
    Rule('INJ-009', 'CWE-79', 'HIGH', 'A03', 'Injection', 'XSS via dangerouslySetInnerHTML', r"""dangerouslySetInnerHTML""", ('javascript', 'typescript'), None),
    Rule('INJ-010', 'CWE-79', 'HIGH', 'A03', 'Injection', 'XSS via document.write()', r"""document\.write\s*\(""", ('javascript', 'typescript'), None),
    Rule('INJ-011', 'CWE-78', 'CRITICAL', 'A03', 'Injection', 'Command injection via child_process', r"""(?:child_process\.)?exec\s*\(\s*(?!['"][^'"]*['"]\s*[,)])""", ('javascript', 'typescript'), None),
    Rule('INJ-012', 'CWE-94', 'HIGH', 'A03', 'Injection', 'Code injection via new Function()', r"""new\s+Function\s*\(""", ('javascript', 'typescript'), None),
    Rule('INJ-013', 'CWE-78', 'CRITICAL', 'A03', 'Injection', 'Command injection via exec.Command with variable', r"""exec\.Command\s*\(\s*[a-z]""", ('go',), r"""exec\.Command\s*\(\s*['"]"""),
    Rule('INJ-014', 'CWE-1336', 'HIGH', 'A03', 'Injection', 'Server-side template injection (SSTI)', r"""(?:render_template_string|Template)\s*\(\s*(?!['"])""", ('python',), None),
    Rule('CRY-001', 'CWE-327', 'HIGH', 'A02', 'Cryptography', 'Weak hash algorithm MD5 used', r"""(?:hashlib\.md5|MD5\.new|crypto\.createHash\s*\(\s*['"]md5['"]\)|md5\.New\(\)|Md5::new)""", ('*',), r"""(?:checksum|etag|cache|fingerprint|#|//)"""),
    Rule('CRY-002', 'CWE-327', 'MEDIUM', 'A02', 'Cryptography', 'Weak hash algorithm SHA1 used for security', r"""(?:hashlib\.sha1|SHA\.new|crypto\.createHash\s*\(\s*['"]sha1['"]\)|sha1\.New\(\)|Sha1::new)""", ('*',), r"""(?:checksum|etag|git|fingerprint|#|//)"""),
    Rule('CRY-003', 'CWE-330', 'HIGH', 'A02', 'Cryptography', 'Insecure random number generator for security context', r"""(?:random\.random|random\.randint|random\.choice|Math\.random)\s*\(""", ('python', 'javascript', 'typescript'), r"""(?:shuffle|sample|jitter|delay|color|position|test|mock|seed)"""),
    Rule('CRY-004', 'CWE-295', 'HIGH', 'A02', 'Cryptography', 'TLS/SSL certificate verification disabled', r"""(?:verify\s*=\s*False|rejectUnauthorized\s*:\s*false|InsecureSkipVerify\s*:\s*true|CERT_NONE)""", ('*',), None),
    Rule('CRY-005', 'CWE-326', 'MEDIUM', 'A02', 'Cryptography', 'Weak encryption key size (< 2048 bits)', r"""(?:generate_private_key|RSA\.generate|generateKeyPair)\s*\([^)]*(?:1024|512|768)""", ('*',), None),
    Rule('CRY-006', 'CWE-327', 'MEDIUM', 'A02', 'Cryptography', 'Deprecated/weak cipher (DES, RC4, Blowfish)', r"""(?:DES\.new|RC4|Blowfish|createCipheriv\s*\(\s*['"](?:des|rc4|bf))""", ('*',), None),
    Rule('AUTH-001', 'CWE-287', 'HIGH', 'A07', 'Authentication', 'Hardcoded admin/default credentials', r"""(?:admin|root|default)\s*[=:]\s*['"](?:admin|root|password|123456|default|test)['"]""", ('*',), None),
    Rule('AUTH-002', 'CWE-306', 'HIGH', 'A01', 'Authentication', 'CORS allow-all origin (*)', r"""(?:Access-Control-Allow-Origin['":\s]+\*|cors\(\s*\)|allow_origins\s*=\s*\[\s*['"]?\*['"]?\s*\])""", ('*',), None),
    Rule('AUTH-003', 'CWE-613', 'MEDIUM', 'A07', 'Authentication', 'JWT without expiration', r"""(?:jwt\.(?:encode|sign))\s*\([^)]*(?!exp)""", ('python', 'javascript', 'typescript'), r"""(?:exp|expiresIn|expires_delta|timedelta)"""),
    Rule('AUTH-004', 'CWE-521', 'MEDIUM', 'A07', 'Authentication', 'Weak password policy (min length < 8)', r"""(?:min[_-]?(?:length|len|size)|minlength)\s*[=:]\s*[1-7]\b""", ('*',), None),
    Rule('AUTH-005', 'CWE-352', 'HIGH', 'A01', 'Authentication', 'Missing CSRF protection on state-changing route', r"""@(?:app|router)\.(?:post|put|patch|delete)\s*\(['"][^'"]+['"]\)""", ('python',), r"""(?:csrf|CSRFProtect|WTF|token)"""),
    Rule('AUTH-006', 'CWE-284', 'CRITICAL', 'A01', 'Authentication', 'Solidity: tx.origin used for authentication', r"""tx\.origin""", ('solidity',), r"""(?://|/\*)\s*.*tx\.origin"""),
    Rule('AUTH-007', 'CWE-284', 'HIGH', 'A01', 'Authentication', 'Solidity: selfdestruct accessible without access control', r"""selfdestruct\s*\(""", ('solidity',), r"""(?:onlyOwner|require\s*\(|modifier)"""),
    Rule('DES-001', 'CWE-502', 'CRITICAL', 'A08', 'Deserialization', 'Unsafe pickle deserialization', r"""pickle\.(?:load|loads)\s*\(""", ('python',), r"""(?:trusted|safe|#.*pickle)"""),
    Rule('DES-002', 'CWE-502', 'HIGH', 'A08', 'Deserialization', 'Unsafe YAML loading (yaml.load without SafeLoader)', r"""yaml\.load\s*\([^)]*(?!Loader\s*=\s*(?:yaml\.)?SafeLoader|Loader\s*=\s*(?:yaml\.)?CSafeLoader)""", ('python',), r"""SafeLoader|safe_load|CSafeLoader"""),
    Rule('DES-003', 'CWE-502', 'HIGH', 'A08', 'Deserialization', 'Unsafe marshal/shelve deserialization', r"""(?:marshal\.loads|shelve\.open)\s*\(""", ('python',), None),
    Rule('DES-004', 'CWE-502', 'HIGH', 'A08', 'Deserialization', 'Unsafe JSON.parse on unvalidated input', r"""JSON\.parse\s*\(\s*(?:req\.|request\.|body\.|params\.)""", ('javascript', 'typescript'), None),
    Rule('CFG-001', 'CWE-489', 'HIGH', 'A05', 'Configuration', 'Debug mode enabled in production code', r"""(?:DEBUG\s*=\s*True|debug\s*[=:]\s*true|\.run\s*\([^)]*debug\s*=\s*True)""", ('*',), r"""(?:if\s+|#|//|test|dev|development|\.env)"""),
    Rule('CFG-002', 'CWE-200', 'MEDIUM', 'A05', 'Configuration', 'Stack trace / verbose error exposed to client', r"""(?:traceback\.format_exc|stack\s*:\s*err\.stack|\.send\s*\(\s*err\.(?:message|stack))""", ('*',), None),
    Rule('CFG-003', 'CWE-319', 'HIGH', 'A02', 'Configuration', 'HTTP used instead of HTTPS for sensitive operation', r"""['"]http://[^'"]*(?:api|auth|login|payment|checkout|admin|token)""", ('*',), r"""(?:localhost|127\.0\.0\.1|0\.0\.0\.0|example\.com|test|mock)"""),
    Rule('CFG-004', 'CWE-693', 'MEDIUM', 'A05', 'Configuration', 'Missing security headers (helmet/CSP not configured)', r"""(?:app\.use\s*\(\s*express\.static|app\.listen)\s*\(""", ('javascript', 'typescript'), r"""(?:helmet|csp|Content-Security-Policy|x-frame-options)"""),
    Rule('CFG-005', 'CWE-532', 'MEDIUM', 'A09', 'Configuration', 'Sensitive information in log statements', r"""(?:logger|log|console)\.\w+\s*\([^)]*(?:password|secret|token|key|credential|ssn|credit.?card)""", ('*',), r"""(?:mask|redact|\*+|#|//)"""),
    Rule('CFG-006', 'CWE-1188', 'MEDIUM', 'A05', 'Configuration', 'Insecure default: binding to 0.0.0.0', r"""(?:host\s*[=:]\s*['"]0\.0\.0\.0['"]|\.listen\s*\([^)]*0\.0\.0\.0|ListenAndServe\s*\(\s*['"](?::|\s*0\.0\.0\.0))""", ('*',), None),
    Rule('CFG-007', 'CWE-319', 'HIGH', 'A05', 'Configuration', 'Go HTTP server without TLS', r"""http\.ListenAndServe\s*\(""", ('go',), r"""(?:ListenAndServeTLS|TLS|tls)"""),
    Rule('PTH-001', 'CWE-22', 'HIGH', 'A01', 'Path Traversal', 'Path traversal via unsanitized user input in file path', r"""(?:open|readFile|readFileSync|os\.path\.join|path\.join)\s*\([^)]*(?:req\.|request\.|params\.|query\.|args\.|input)""", ('python', 'javascript', 'typescript'), None),
    Rule('PTH-002', 'CWE-22', 'HIGH', 'A01', 'Path Traversal', 'Path traversal: user input directly in file operation', r"""(?:send_file|send_from_directory|static_file)\s*\([^)]*(?:request\.|args\.get)""", ('python',), None),
    Rule('PTH-003', 'CWE-73', 'MEDIUM', 'A01', 'Path Traversal', 'File operation with external input not validated', r"""(?:shutil\.(?:copy|move|rmtree)|os\.(?:remove|unlink|rename))\s*\(\s*(?!['"])""", ('python',), None),
    Rule('SOL-001', 'CWE-841', 'CRITICAL', 'A04', 'Reentrancy', 'Solidity: Potential reentrancy (external call before state update)', r"""\.call\{.*value.*\}\s*\(""", ('solidity',), None),
    Rule('SOL-002', 'CWE-190', 'HIGH', 'A04', 'Integer Overflow', 'Solidity: Unchecked arithmetic (pre-0.8 pattern without SafeMath)', r"""(?:pragma\s+solidity\s+[<^]?0\.[4-7])""", ('solidity',), r"""SafeMath"""),
    Rule('SOL-003', 'CWE-284', 'HIGH', 'A01', 'Access Control', 'Solidity: delegatecall to potentially untrusted contract', r"""\.delegatecall\s*\(""", ('solidity',), None),
    Rule('SOL-004', 'CWE-252', 'MEDIUM', 'A04', 'Error Handling', 'Solidity: Unchecked return value from external call', r"""(?:\.call|\.send|\.transfer)\s*\([^)]*\)\s*;""", ('solidity',), r"""(?:require|assert|bool\s+success)"""),
    Rule('SOL-005', 'CWE-330', 'HIGH', 'A02', 'Cryptography', 'Solidity: block.timestamp used for randomness', r"""block\.(?:timestamp|number|difficulty|prevrandao)\s*[%&|^]""", ('solidity',), None),
    Rule('RST-001', 'CWE-676', 'MEDIUM', 'A04', 'Memory Safety', 'Rust: unsafe block usage', r"""\bunsafe\s*\{""", ('rust',), None),
    Rule('RST-002', 'CWE-252', 'LOW', 'A04', 'Error Handling', 'Rust: unwrap() on potentially fallible operation', r"""\.unwrap\(\)""", ('rust',), r"""(?:test|spec|#\[cfg\(test\)\]|#\[test\]|_test\.rs)"""),
    Rule('RST-003', 'CWE-78', 'HIGH', 'A03', 'Injection', 'Rust: Command execution with variable argument', r"""Command::new\s*\(\s*(?!['"])""", ('rust',), None),
    Rule('GEN-001', 'CWE-918', 'HIGH', 'A10', 'SSRF', 'Server-side request with user-controlled URL', r"""(?:requests\.get|fetch|http\.Get|urllib\.request\.urlopen|axios\.get)\s*\(\s*(?!['"])""", ('*',), r"""(?:const|static|CONFIG|BASE_URL|API_URL)"""),
    Rule('GEN-002', 'CWE-209', 'LOW', 'A05', 'Information Disclosure', 'TODO/FIXME related to security', r"""(?:#|//|/\*)\s*(?:TODO|FIXME|HACK|XXX)\s*.*(?:secur|auth|crypt|password|token|vuln|csrf|xss|inject|sanitiz)""", ('*',), None),
    Rule('GEN-003', 'CWE-311', 'MEDIUM', 'A02', 'Configuration', 'Insecure protocol (http:// for API/auth endpoint)', r"""['"]http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0|10\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01]))""", ('*',), r"""(?:example|test|mock|placeholder|schema\.org|www\.w3\.org)"""),
    Rule('GEN-004', 'CWE-250', 'MEDIUM', 'A05', 'Configuration', 'Running as root / elevated privileges', r"""(?:USER\s+root|run.*as.*root|chmod\s+777|chmod\s+666|os\.setuid\s*\(\s*0\s*\))""", ('*',), None),
    Rule('GEN-005', 'CWE-1104', 'LOW', 'A06', 'Dependencies', 'Pinned to wildcard dependency version', r"""['"]\*['"]|['"]latest['"]""", ('javascript', 'typescript'), r"""(?:peerDependencies|devDependencies.*test)"""),
]
