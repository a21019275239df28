"""Rules for settings that are findings unless a guard stands beside them.

Fixed values: settings, flags, ports, key prefixes and placeholder secrets of each product.  Each rule carries a probe
that it must flag and a clean text that it must leave alone, both our own.
"""

from __future__ import annotations

from itertools import permutations

from ..functions.rules import ANYWHERE, ELSEWHERE, NO, SLASH_COMMENT, XML_COMMENT, YES, Rule, flag, setting
from .code_rules import PYTHON

LOOPBACK = r"(?:127\.[0-9.]+|localhost|\[?::1\]?)"
#: Lines of a YAML block below its head.
_BELOW = r"(?:[ \t]+[^\n]*\n|[ \t]*\n)*?[ \t]+"


def _nested(parents: str, key: str, values: str) -> str:
    """A YAML key below each of the parents, separated by dots."""
    return r"(?im)^[ \t]*" + "".join(rf"[\"']?{p}[\"']?[ \t]*:[ \t]*\n{_BELOW}" for p in parents.split(".")) + rf"[\"']?(?:{key})[\"']?[ \t]*:[ \t]*[\"']?(?:{values})(?:[\"']|[ \t]|$)"


def _block(name: str, body: str) -> str:
    """A setting inside a braced block."""
    return rf"(?i)(?:^|[^A-Za-z0-9_])[\"']?{name}[\"']?[ \t]*[=:]?[ \t]*\{{[^{{}}]*{body}"


def _together(*parts: str) -> tuple[str, ...]:
    """Parts of one JSON object, in any order."""
    return tuple(r"(?s)\{[^{}]*" + r"[^{}]*".join(p) for p in permutations(parts))


_ALLOW = r"\"Effect\"\s*:\s*\"(?i:allow)\""
_ANYBODY = r"\"Principal\"\s*:\s*(?:\"\*\"|\{\s*\"AWS\"\s*:\s*(?:\[\s*)?\"\*\"\s*\]?\s*\})"
_PORTS = "22|23|135|139|445|1433|1521|2049|2181|2375|2376|2379|2380|3306|3389|4505|4506|5432|5601|5672|5900|5984|6379|6443|7000|7001|8500|9042|9092|9200|9300|10250|11211|15672|27017|27018|50070"
_WORLD = r"(?:0\.0\.0\.0/0|::/0)"
_EMPTY_OR = r"(?:[\"']{2}|[\"']?(?:%s)[\"']?)?[ \t]*;?[ \t]*$"
_PLACEHOLDER = r"change[_-]?me|<[^>\n]*>|replace[_-]?me|todo|xxx+|placeholder|secret|password"
_NATS = r"(?:nats|jetstream|4222)"
_NATS_LISTENS = r"^[ \t]*(?:port|listen)[ \t]*[:=]"

RULES = [
    Rule("ansible_shell_jinja", (r"(?m)^[ \t]*(?:-[ \t]+)?(?:ansible\.builtin\.|ansible\.legacy\.|builtin\.)?(?:shell|command)[ \t]*:[ \t]*(?:[^|>\n \t][^\n]*)?\{\{[^}|]*(?:\|[ \t]*(?:[a-pr-zA-Z_]|q[a-tv-z])[^}|]*)*\}\}",), "- shell: rm -rf {{ tmp_dir }}", clean="- shell: rm -rf {{ tmp_dir | quote }}\n- command: uptime\n- shell: |\n    echo {{ x }}"),
    Rule("argo_workflows_server_mode", (r"(?i)--auth-mode[= ][\"']?server(?:[\s\"',\]]|$)", r"(?im)^[ \t]*mode:[ \t]*(?:\n[ \t]*-[ \t]*[\"']?server[\"']?[ \t]*$|\[[ \t]*[\"']?server[\"']?[ \t]*\])"), 'args: ["server", "--auth-mode=server"]', gate=r"(?i)argo|auth-mode|auth:\s*\n\s*mode:", unless=(r"(?i)--auth-mode[= ][\"']?(?:client|sso)", r"(?im)^[ \t]*-[ \t]*[\"']?(?:client|sso)[\"']?[ \t]*$"), clean="args: [server, --auth-mode=server, --auth-mode=sso]"),
    Rule("aws_iam_wildcard", (*_together(_ALLOW, r"\"NotAction\""), *_together(_ALLOW, r"\"Action\"\s*:\s*(?:\[[^\]]*)?\"(?:[a-z0-9-]+:)?\*\"", r"\"Resource\"\s*:\s*(?:\[\s*)?\"\*\""), *_together(_ALLOW, r"\"Action\"\s*:\s*(?:\[[^\]]*)?\"(?:iam|sts|kms|organizations|account):\*\"")), '{"Version": "2012-10-17", "Statement": [{"Effect": "Allow", "Action": "*", "Resource": "*"}]}', gate=r"\"Statement\"", unless=(r"\"_iam_wildcard_allowed\"\s*:\s*true", r"\"Sid\"\s*:\s*\"[^\"]*-AdminAllowed\""), clean='{"Version": "1", "Statement": [{"Effect": "Deny", "Action": "*", "Resource": "*"}, {"Effect": "Allow", "Action": "s3:GetObject", "Resource": "*"}]}', comments=None),
    Rule("code_server_no_auth", (r"(?m)^auth[ \t]*:[ \t]*[\"']?none\b", r"(?is)code-server.*?--auth(?:[= ]|[\"'],\s*[\"'])none\b", r"(?is)code-server.*?[\s\"'-]AUTH[ \t]*[=:][ \t]*[\"']?none\b"), "exec code-server --auth none", clean="auth: password\n# code-server\nnode:\n  auth: none"),
    Rule("concourse_weak_local_user", (r"(?im)(?:--add-local-user[= ]|CONCOURSE_ADD_LOCAL_USER[\"']?[ \t]*[:=][ \t]*)[\"']?[A-Za-z0-9_.-]+:(?:admin|password|concourse|changeme|please_change_me|test|secret|123456)?(?:[\s\"',\\]|$)", flag("enable-noauth-main-team"), setting("CONCOURSE_ENABLE_NOAUTH_MAIN_TEAM", YES)), "concourse web --add-local-user=admin:admin", clean="concourse web --add-local-user=admin:R4nd0mLongValue77 --main-team-local-user=admin"),
    Rule("concourse_undefined_local_user", (r"(?i)--main-team-local-user[= ]|CONCOURSE_MAIN_TEAM_LOCAL_USER[\"']?[ \t]*[:=]",), "concourse web --main-team-local-user=admin", unless=(r"(?i)--add-local-user|CONCOURSE_ADD_LOCAL_USER",), clean="concourse web --add-local-user=admin:R4nd0mLongValue77 --main-team-local-user=admin"),
    Rule("consul_default_policy_allow", (_block("acl", r"default_policy[\"']?[ \t]*[=:][ \t]*\"allow\""), r"(?im)^[ \t]*[\"']?acl_default_policy[\"']?[ \t]*[=:][ \t]*\"allow\"", flag("default-policy", "allow"), _nested("acl", "default_policy", "allow")), 'acl {\n  enabled = true\n  default_policy = "allow"\n}', clean='acl { default_policy = "deny" }\nintentions { default_policy = "allow" }\n# default_policy = "allow"', comments=SLASH_COMMENT),
    Rule("consul_acl_disabled", (_block("acl", r"enabled[\"']?[ \t]*[=:][ \t]*false\b"), _block("acl", r"default_policy[\"']?[ \t]*[=:][ \t]*\"allow\""), _nested("acl", "enabled", "false"), _nested("acl", "default_policy", "allow"), r"(?i)\bconsul[\"',\s]+agent\b[^\n]*[\s\"']-dev\b"), "consul agent -dev -client 0.0.0.0", gate=r"(?i)acl|consul", clean='acl {\n enabled = true\n default_policy = "deny"\n}\nconsul agent -server', comments=SLASH_COMMENT),
    Rule("coredns_acl_allow_all", (rf"(?m)^[ \t]*(?:[a-z]+://)?(?:\.|0\.0\.0\.0|\[?::\]?)?(?::[0-9]+)?[ \t]*\{{(?:[^{{}}]|\{{[^{{}}]*\}})*?\bacl\b[^{{}}]*\{{[^{{}}]*allow[ \t]+(?:type[ \t]+[A-Z ]+[ \t]+)?net[ \t]+[^\n]*{_WORLD}",), ".:53 {\n acl {\n  allow net 0.0.0.0/0\n }\n}", unless=(rf"(?:block|filter)[ \t]+[^\n]*net[ \t]+[^\n]*{_WORLD}",), clean=".:53 {\n acl {\n  allow net 10.0.0.0/8\n }\n}"),
    Rule("cortex_single_tenant", (setting("auth_enabled|multitenancy_enabled", NO), flag(r"auth\.(?:multitenancy-)?enabled", NO), r"(?im)^[ \t]*-?[ \t]*no_auth_tenant[ \t]*:"), "# cortex\nauth_enabled: false", gate=r"(?i)cortex", unless=(setting("auth_enabled", YES),), clean="# cortex\nauth_enabled: true\nno_auth_tenant: x"),
    Rule("cortex_remote_write_no_tenant", (r"(?is)remote_write[ \t]*:.*?url[ \t]*:[^\n]*cortex",), "remote_write:\n  - url: http://cortex.example.org/api/v1/push", unless=(r"(?i)X-Scope-OrgID",), clean="remote_write:\n  - url: http://cortex.example.org/push\n    headers:\n      X-Scope-OrgID: a"),
    Rule("crowdsec_lapi_public", (rf"(?im)^[ \t]*listen_uri[ \t]*:[ \t]*[\"']?{ANYWHERE}?:[0-9]+",), "api:\n  server:\n    listen_uri: 0.0.0.0:8080", unless=(r"(?im)^[ \t]+tls[ \t]*:",), clean="api:\n  server:\n    listen_uri: 127.0.0.1:8080"),
    Rule("compose_privileged", (setting("privileged", YES), r"(?im)^[ \t]*cap_add[ \t]*:[ \t]*(?:\[[^\]]*|(?:\n[ \t]*-[^\n]*)*?\n[ \t]*-[ \t]*)[\"']?(?:CAP_)?(?:ALL|SYS_ADMIN|SYS_PTRACE|SYS_MODULE|DAC_READ_SEARCH|NET_ADMIN)\b", r"(?i)(?:seccomp|apparmor)[:=]unconfined|no-new-privileges[:=]false", setting("pid|ipc|network_mode|userns_mode", "host")), "services:\n  a:\n    privileged: true", gate=r"(?m)^services[ \t]*:", clean="services:\n  a:\n    privileged: false\n    cap_drop:\n      - ALL\n    cap_add:\n      - NET_BIND_SERVICE"),
    Rule("docker_registry_no_auth", (), "version: 0.1\nstorage:\n  filesystem: {}\nhttp:\n  addr: :5000", gate=r"(?ms)^version[ \t]*:[ \t]*[\"']?0\.1.*^(?:storage|http)[ \t]*:", needed=(r"(?m)^auth[ \t]*:[ \t]*\n(?:[ \t]*\n)*[ \t]+(?:htpasswd|token)\b",), clean="version: 0.1\nauth:\n  htpasswd:\n    realm: r\nhttp:\n  addr: :5000"),
    Rule("docker_registry_compose_no_auth", (r"(?im)^[ \t]*image[ \t]*:[ \t]*[\"']?(?:docker\.io/)?(?:library/)?(?:registry|distribution/distribution)(?::|[\"']?[ \t]*$)",), "services:\n  r:\n    image: registry:2", unless=(r"(?i)REGISTRY_AUTH[\"']?[ \t]*[:=][ \t]*[\"']?(?:htpasswd|token)|REGISTRY_AUTH_TOKEN_REALM",), clean="services:\n  r:\n    image: registry:2\n    environment:\n      REGISTRY_AUTH: htpasswd"),
    Rule("elasticsearch_security_off", (r"(?im)xpack\.security\.(?:enabled|transport\.ssl\.enabled|http\.ssl\.enabled)[\"']?[ \t]*[:=][ \t]*[\"']?(?:false|no|off|0)\b", r"(?im)plugins\.security\.disabled[\"']?[ \t]*[:=][ \t]*[\"']?(?:true|yes|on|1)\b", r"(?im)plugins\.security\.ssl\.http\.enabled[\"']?[ \t]*[:=][ \t]*[\"']?(?:false|no|off|0)\b", _nested("xpack.security", "enabled", NO), _nested("plugins.security", "disabled", YES), r"(?is)anonymous.{0,200}?roles[ \t]*:[^\n]*(?:superuser|all_access|kibana_admin)"), "network.host: 0.0.0.0\nxpack.security.enabled: false", clean="network.host: _local_\nxpack.security.enabled: true"),
    Rule("elasticsearch_xpack_disabled", (r"(?im)xpack\.security\.enabled[\"']?[ \t]*[:=][ \t]*[\"']?(?:false|no|off|0)\b", r"(?is)xpack\.security\.http\.ssl\.enabled[^\n]*false.*xpack\.security\.transport\.ssl\.enabled[^\n]*false", r"(?is)xpack\.security\.transport\.ssl\.enabled[^\n]*false.*xpack\.security\.http\.ssl\.enabled[^\n]*false", r"(?im)xpack\.security\.(?:http|transport)\.ssl\.enabled=[\"']?false\b", _nested("xpack.security", "enabled", "false")), "environment:\n  - xpack.security.enabled=false", clean="xpack.security.enabled: true\nxpack.security.transport.ssl.enabled: true"),
    Rule("elasticsearch_cors_wildcard", (r"(?im)allow-origin[\"']?[ \t]*[:=][ \t]*[\"']?(?:\*|/\.\*/)",), 'http.cors.enabled: true\nhttp.cors.allow-origin: "*"', gate=r"(?is)http\.cors\.enabled[\"']?[ \t]*[:=][ \t]*[\"']?true|cors[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+enabled[ \t]*:[ \t]*true", clean='http.cors.enabled: false\nhttp.cors.allow-origin: "*"'),
    Rule("envoy_admin_public", (rf"(?im)^[ \t{{]*\"?admin\"?[ \t]*:[ \t]*\{{?\s*(?:(?:access_log|profile|- name|name|typed_config|\"@type\"|path|\"access_log)[^\n]*\n\s*)*\"?address\"?[ \t]*:\s*\{{?\s*\"?socket_address\"?[ \t]*:\s*\{{?\s*(?:\"?protocol\"?[ \t]*:[ \t]*\"?[A-Z]+\"?,?\s*)?\"?address\"?[ \t]*:[ \t]*[\"']?(?:{ELSEWHERE}|\{{\{{|\$)",), "admin:\n  address:\n    socket_address:\n      address: 0.0.0.0\n      port_value: 9901", clean="admin:\n  address:\n    socket_address:\n      address: 127.0.0.1\n      port_value: 9901\nstatic_resources:\n  listeners:\n  - address:\n      socket_address:\n        address: 0.0.0.0"),
    Rule("etcd_peer_no_client_cert", (rf"(?im)^[ \t]*[\"']?(?:listen|initial-advertise)-peer-urls[\"']?[ \t]*:[^\n]*http://{ELSEWHERE}",), "listen-peer-urls: http://10.0.0.1:2380", gate=rf"(?im)^[ \t]*[\"']?(?:listen|initial-advertise)-peer-urls[\"']?[ \t]*:[^\n]*https?://{ELSEWHERE}", needed=(r"(?is)peer-transport-security[\"']?[ \t]*:.*?client-cert-auth[\"']?[ \t]*:[ \t]*[\"']?true", r"(?is)peer-transport-security[\"']?[ \t]*:.*?cert-file[\"']?[ \t]*:[ \t]*[^\s]"), clean="listen-peer-urls: https://10.0.0.1:2380\npeer-transport-security:\n  cert-file: /a\n  key-file: /b\n  client-cert-auth: true"),
    Rule("frps_dashboard_default_password", (r"(?im)^[ \t]*(?:dashboard_pwd|webServer\.password)[ \t]*[:=][ \t]*(?:[\"']{2}|[\"']?(?:admin|password|admin123|frp|changeme)[\"']?)?[ \t]*$", r"(?ims)^[ \t]*(?:\[webServer\]|webServer[ \t]*:)[ \t]*\n(?:[^\[\n][^\n]*\n|\n)*?[ \t]*password[ \t]*[:=][ \t]*(?:[\"']{2}|[\"']?(?:admin|password|admin123|frp|changeme)[\"']?)?[ \t]*$"), '[common]\ndashboard_user = "admin"\ndashboard_pwd = "admin"', clean='[common]\ndashboard_port = 7500\ndashboard_pwd = "h7Kq-29vXw"'),
    Rule("frps_dashboard_no_password", (r"(?im)^[ \t]*(?:dashboard_(?:addr|port)|webServer\.(?:addr|port))[ \t]*[:=]", r"(?ims)^[ \t]*(?:\[webServer\]|webServer[ \t]*:)[ \t]*\n(?:[^\[\n][^\n]*\n|\n)*?[ \t]*(?:addr|port)[ \t]*[:=]"), "[common]\nbind_port = 7000\ndashboard_port = 7500", unless=(r"(?im)^[ \t]*(?:dashboard_pwd|webServer\.password|password)[ \t]*[:=]",), clean="[common]\nbind_port = 7000"),
    Rule("ftp_anonymous_login", (setting("anonymous_enable|anon_upload_enable|anon_mkdir_write_enable|no_anon_password", "YES"), r"(?is)<Anonymous[^>]*>.*?AnonRequirePassword[ \t]+off", r"(?im)^[ \t]*NoAnonymous[ \t]*[= ][ \t]*no\b", r"(?i)echo[ \t]+[\"']?no[\"']?[ \t]*>[^\n]*NoAnonymous"), "anonymous_enable=YES", clean="anonymous_enable=NO"),
    Rule("ftp_anonymous_block", (r"(?i)<Anonymous\b[^>]*>",), "<Anonymous /srv/ftp>\n User ftp\n</Anonymous>", unless=(r"(?i)AnonRequirePassword[ \t]+on\b",), clean="<Anonymous /srv/ftp>\n AnonRequirePassword on\n</Anonymous>"),
    Rule("pure_ftpd_anonymous", (r"(?im)^(?:CMD|ENTRYPOINT|RUN|ExecStart=)[^\n]*pure-ftpd\b",), 'CMD ["pure-ftpd", "-c", "50"]', unless=(r"(?m)pure-ftpd\b[^\n]*(?:[\s\"']-E\b|--noanonymous)",), clean='CMD ["pure-ftpd", "-E"]'),
    Rule("gotify_default_password", (r"(?im)^[ \t]*defaultuser[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+pass[ \t]*:[ \t]*(?:[\"']{2}|[\"']?(?:<[^>\n]*>|changeme|password|[^\s\"'#$]{1,7})[\"']?)?[ \t]*$", r"(?im)^[ \t]*passstrength[ \t]*:[ \t]*[\"']?[0-7][\"']?[ \t]*$"), "defaultuser:\n  name: admin\n  pass: admin", clean="defaultuser:\n  name: admin\n  pass: w8Tr-441-kkQp\npassstrength: 10"),
    Rule("gotify_no_password", (), "defaultuser:\n  name: admin", gate=r"(?im)^[ \t]*defaultuser[ \t]*:", needed=(r"(?im)^[ \t]+pass[ \t]*:",), clean="defaultuser:\n  name: admin\n  pass: w8Tr-441-kkQp"),
    Rule("harbor_default_password", (r"(?im)^[ \t]*(?:-[ \t]*|export[ \t]+)?[\"']?(?i:harbor_admin_password)[\"']?[ \t]*[:=][ \t]*\"?Harbor12345\"?[ \t]*$",), "harbor_admin_password: Harbor12345", clean="harbor_admin_password: ${HARBOR_ADMIN_PASSWORD}"),
    Rule("helm_host_path", (r"(?m)^[ \t]*(?:-[ \t]+)?hostPath[ \t]*:",), "volumes:\n- name: a\n  hostPath:\n    path: /etc", clean="volumes:\n- name: a\n  emptyDir: {}\n# hostPath: /etc"),
    Rule("kibana_no_verification", (r"(?im)elasticsearch[._]ssl[._]verificationmode[\"']?[ \t]*[:=][ \t]*[\"']?none\b", _nested("ssl", "verificationMode", "none"), r"(?is)name[ \t]*:[ \t]*[\"']?ELASTICSEARCH_SSL_VERIFICATIONMODE[\"']?\s+value[ \t]*:[ \t]*[\"']?none\b"), "elasticsearch.ssl.verificationMode: none", clean="elasticsearch.ssl.verificationMode: full"),
    Rule("knot_update_anyone", (rf"(?im)^[ \t]+actions?[ \t]*:[^\n]*\bupdate\b[^\n]*\n(?:[ \t]+[a-z][^\n]*\n)*?[ \t]+address[ \t]*:[ \t]*\[?[ \t]*[\"']?(?:{_WORLD}|any\b)", rf"(?im)address[ \t]*:[ \t]*\[?[ \t]*[\"']?(?:{_WORLD}|any\b)[^\n]*\n(?:[ \t]+[a-z][^\n]*\n)*?[ \t]+actions?[ \t]*:[^\n]*\bupdate\b", r"(?im)^[ \t]*-[ \t]+id[ \t]*:[^\n]*\n(?:[ \t]+(?:key|deny|update-[a-z-]+)[^\n]*\n)*[ \t]+actions?[ \t]*:[^\n]*\bupdate\b[^\n]*(?:\n[ \t]+(?:key|deny|update-[a-z-]+)[^\n]*)*(?:\n[ \t]*-|\n[a-z]|\s*\z)"), "acl:\n  - id: a\n    address: 0.0.0.0/0\n    action: update\n", gate=r"(?m)^acl[ \t]*:", clean="acl:\n  - id: a\n    address: 10.0.0.0/8\n    action: update\n  - id: b\n    action: transfer\n"),
    Rule("krakend_debug", (setting("debug_endpoint|echo_endpoint|KRAKEND_DEBUG_ENDPOINT|KRAKEND_ECHO_ENDPOINT", YES), r"(?im)krakend[\"',\s]+(?:run|check)\b[^\n]*[\s\"'](?:-d|--debug|-e|--echo)(?:[\"'\s,\]]|$)"), '{"debug_endpoint": true}\n"echo_endpoint": true,', clean='"debug_endpoint": false\nkrakend run -c k.json', comments=SLASH_COMMENT),
    Rule("kubeflow_dashboard_open", (r"(?im)^[ \t]*action[ \t]*:[ \t]*[\"']?ALLOW\b",), "kind: AuthorizationPolicy\nmetadata:\n  namespace: kubeflow\nspec:\n  action: ALLOW\n  rules: []", gate=r"(?is)AuthorizationPolicy.*(?:kubeflow|centraldashboard)|(?:kubeflow|centraldashboard).*AuthorizationPolicy", unless=(r"(?im)^[ \t]*-[ \t]*(?:from|to|when)[ \t]*:",), clean="kind: AuthorizationPolicy\nmetadata:\n  namespace: kubeflow\nspec:\n  action: ALLOW\n  rules:\n  - from:\n    - source: {}"),
    Rule("kubelet_anonymous", (_nested("anonymous", "enabled", "true"), r"(?im)^[ \t]*readOnlyPort[ \t]*:[ \t]*[1-9]", flag("anonymous-auth", "true"), flag("read-only-port", "[1-9][0-9]*")), "authentication:\n  anonymous:\n    enabled: true", gate=r"(?i)kubelet|anonymous|read-?only-?port", clean="kind: KubeletConfiguration\nauthentication:\n  anonymous:\n    enabled: false\nreadOnlyPort: 0"),
    Rule("kubelet_bare_start", (r"(?m)(?:^|[ \t/])kubelet[ \t]+(?:\\|--)",), "exec /usr/bin/kubelet \\\n  --hostname-override=n1", unless=(r"--config\b|--anonymous-auth=false",), clean="exec /usr/bin/kubelet --config /etc/k.yaml"),
    # what base64 makes of well-known key prefixes
    Rule("kubernetes_secret_plain", (r"(?m)^[ \t]+[\w.-]+[ \t]*:[ \t]*[\"']?(?:QUtJQ|QVNJQ|c2tfbGl2ZV|c2tfdGVzdF|Z2hwX|Z2hvX|Z2hzX|Z2h1X|Z2l0aHViX3BhdF|Z2xwYXQt|QUl6Y|eG94[YcGHJ]|eWEyOS|U0cu|QmVhcmVyI|LS0tLS1CRUdJTi|ZXlK)", r"(?ms)^[ \t]*stringData[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+[\w.-]+[ \t]*:[ \t]*[\"']?(?:AKIA|ASIA|sk_live_|ghp_|gho_|ghs_|ghu_|github_pat_|glpat-|AIza|xox[bpar]-|ya29\.|SG\.|eyJ[A-Za-z0-9_-]+\.|-----BEGIN|Bearer )", r"(?ms)^[ \t]*data[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+[\w.-]+[ \t]*:[ \t]*[\"']?[A-Za-z0-9][^\s\"'<>{}#]*[!@%^&*~]"), "kind: Secret\ndata:\n  key: QUtJQUlPU0ZPRE5ON0VYQU1QTEU=", gate=r"(?m)^[ \t]*kind[ \t]*:[ \t]*[\"']?Secret[\"']?[ \t]*$", clean="kind: Secret\ndata:\n  key: Y2hhbmdlbWU=\nstringData:\n  token: <replace>"),
    Rule("mattermost_developer_mode", (r"(?i)\"Enable(?:Developer|Testing)\"\s*:\s*true", setting("MM_SERVICESETTINGS_ENABLE(?:DEVELOPER|TESTING)", YES), r"(?i)ServiceSettings\.Enable(?:Developer|Testing)[= ][\"']?true"), '{"ServiceSettings": {"EnableDeveloper": true}}', clean='{"ServiceSettings": {"EnableDeveloper": false}}\nmmctl config get ServiceSettings.EnableTesting'),
    Rule("minio_anonymous_policy", (*_together(_ALLOW, _ANYBODY, r"\"Action\"\s*:\s*(?:\[[^\]]*)?\"(?:\*|s3:(?:\*|PutObject|DeleteObject|PutObjectAcl|DeleteBucket|PutBucketPolicy|ListBucket|ListBucketMultipartUploads))\""),), '{"Statement": [{"Effect": "Allow", "Principal": {"AWS": ["*"]}, "Action": ["s3:PutObject"], "Resource": "arn:aws:s3:::b/*"}]}', unless=(r"minio-anonymous-allowed",), clean='{"Statement": [{"Effect": "Allow", "Principal": "*", "Action": "s3:GetObject", "Resource": "arn:aws:s3:::b/*"}]}', comments=None),
    Rule("mlflow_no_auth", (r"(?i)mlflow[\"',\s]+(?:server|ui)\b(?:[^\n]*\\\n)*[^\n]*(?:--host|-h)[\"',=\s]+(?:0\.0\.0\.0|::)", r"(?i)MLFLOW_AUTH_CONFIG_PATH[\"']?[ \t]*[:=][ \t]*[\"']?/dev/null", r"(?is)mlflow[\"',\s]+(?:server|ui)\b[^#]{0,300}?--host[\"',=\s]+(?:0\.0\.0\.0|::)"), "mlflow server --host 0.0.0.0 --port 5000", unless=(r"--app-name\b", r"mlflow-auth-external"), clean="mlflow server --host 127.0.0.1"),
    Rule("mlflow_image_no_host", (r"(?im)^(?:CMD|ENTRYPOINT)[^\n]*mlflow[\"',\s]+server\b",), 'CMD ["mlflow", "server", "--port", "5000"]', unless=(r"--host\b", r"--app-name\b", r"mlflow-auth-external"), clean='CMD ["mlflow", "server", "--host", "127.0.0.1"]'),
    Rule("mosquitto_listener_no_tls", (rf"(?im)^[ \t]*listener[ \t]+[0-9]+(?:[ \t]+{ELSEWHERE}[^\n]*)?[ \t]*$", r"(?im)^(?:CMD|ENTRYPOINT)[^\n]*mosquitto[\"',\s]+-p\b[^\n]*$"), "listener 1883 0.0.0.0\nallow_anonymous false\npassword_file /p", unless=(r"(?im)^[ \t]*(?:cafile|certfile|keyfile|capath)[ \t]", r"mosquitto[^\n]*-c\b"), clean="listener 1883 127.0.0.1\nlistener 8883\ncafile /a\ncertfile /b\nkeyfile /c"),
    Rule("mosquitto_port_no_tls", (r"(?im)^[ \t]*port[ \t]+1883[ \t]*$",), "port 1883\nallow_anonymous false\npassword_file /p", unless=(r"(?im)^[ \t]*(?:cafile|certfile|keyfile|capath|listener)[ \t]", rf"(?im)^[ \t]*bind_address[ \t]+{LOOPBACK}"), clean="port 1883\nbind_address 127.0.0.1"),
    Rule("mqtt_anonymous", (r"(?im)^[ \t]*allow_anonymous[ \t]+true\b", r"(?im)^[ \t]*anonymous[ \t]+yes\b", setting("(?:MOSQUITTO|MQTT|HIVEMQ)_ALLOW_ANONYMOUS", YES)), "allow_anonymous true", clean="allow_anonymous false"),
    Rule("mqtt_listener_no_auth", (rf"(?im)^[ \t]*listener[ \t]+[0-9]+(?:[ \t]+{ELSEWHERE}[^\n]*)?[ \t]*$",), "listener 1883 0.0.0.0\npersistence true", unless=(r"(?im)^[ \t]*(?:password_file|psk_file|auth_plugin|plugin)[ \t]|require_certificate[ \t]+true|allow_anonymous[ \t]+false", r"mqtt-anon-ok"), clean="listener 1883 127.0.0.1"),
    Rule("nats_no_auth", (), "port: 4222\nhttp_port: 8222", gate=rf"(?ims){_NATS}.*{_NATS_LISTENS}|{_NATS_LISTENS}.*{_NATS}", needed=(rf"(?is)authorization[ \t]*[:=]?[ \t]*\{{.*?(?:(?:password|token)[ \t]*[:=][ \t]*[\"']?(?:[^\s\"'<c]|c[^h])|users[ \t]*[:=][ \t]*\[)|operator[ \t]*[:=]|verify[ \t]*[:=][ \t]*true",), unless=(rf"(?im)^[ \t]*(?:host|listen)[ \t]*[:=][ \t]*[\"']?{LOOPBACK}",), clean="# nats\nport: 4222\nauthorization {\n  user: a\n  password: h7Kq29vXw\n}"),
    Rule("nginx_old_tls", (r"(?im)^[^#\n]*\bssl_protocols\b[^;\n]*[ \t](?:SSLv2|SSLv3|TLSv1|TLSv1\.1)(?:[ \t;]|$)",), "server {\n listen 443 ssl;\n ssl_protocols TLSv1 TLSv1.2;\n}", gate=r"(?i)listen[^;\n]*\b(?:ssl|quic)\b", clean="server {\n listen 443 ssl;\n ssl_protocols TLSv1.2 TLSv1.3;\n}"),
    Rule("nginx_stub_status_open", (rf"(?i)location[^{{}}]*\{{[^{{}}]*stub_status[^{{}}]*(?:allow[ \t]+(?:all|{_WORLD})|auth_basic[ \t]+off)", rf"(?i)location[^{{}}]*\{{[^{{}}]*(?:allow[ \t]+(?:all|{_WORLD})|auth_basic[ \t]+off)[^{{}}]*stub_status", r"(?i)location[^{}]*\{\s*(?:(?:access_log|error_log|default_type|add_header|log_not_found|allow|server_tokens)[^;{}]*;\s*)*stub_status[^;{}]*;\s*(?:(?:access_log|error_log|default_type|add_header|log_not_found|allow|server_tokens)[^;{}]*;\s*)*\}"), "location /s {\n stub_status;\n}", clean="location /s {\n stub_status;\n allow 127.0.0.1;\n deny all;\n}"),
    Rule("nifi_single_user", (r"(?is)SingleUserLoginIdentityProvider.*?<property name=\"Username\">\s*(?:admin)?\s*</property>", r"(?is)SingleUserLoginIdentityProvider.*?<property name=\"Password\">\s*[^$<\s][^<]*</property>", rf"(?ims)single-user-provider.*^[ \t]*nifi\.web\.https\.host[ \t]*=[ \t]*(?:{ELSEWHERE}[^\n]*)?[ \t]*$", r"(?is)<authorizer>(?:[^<]|<identifier>|</identifier>)*single-user-authorizer"), '<class>org.apache.nifi.authentication.single.user.SingleUserLoginIdentityProvider</class>\n<property name="Username">admin</property>', clean="nifi.security.user.login.identity.provider=ldap-provider\nnifi.web.https.host=10.0.0.1", comments=XML_COMMENT),
    Rule("node_red_no_admin_auth", (), "module.exports = {\n uiPort: 1880,\n // adminAuth: { type: 'credentials' },\n flowFile: 'flows.json'\n}", gate=r"(?is)(?:module\.exports|export default).*(?:uiPort|httpAdminRoot|flowFile|functionGlobalContext)", needed=(r"\badminAuth\s*:",), clean="module.exports = {\n uiPort: 1880,\n adminAuth: { type: 'credentials' }\n}", comments=SLASH_COMMENT),
    Rule("nomad_acl_disabled", (_block("acl", r"enabled[\"']?[ \t]*[=:][ \t]*(?:false|0|\"false\")"),), "server {\n enabled = true\n}\nacl {\n enabled = false\n}", gate=r"(?i)\b(?:server|client)[\"']?[ \t]*[=:]?[ \t]*\{|nomad", clean="server {\n enabled = true\n}\nacl {\n enabled = true\n}", comments=SLASH_COMMENT),
    Rule("nomad_no_acl", (), 'datacenter = "a"\nserver {\n enabled = true\n}', gate=r"(?is)(?:^|[\s{,])[\"']?(?:server|client)[\"']?[ \t]*[=:]?[ \t]*\{[^{}]*[\"']?enabled[\"']?[ \t]*[=:][ \t]*true|hashicorp/nomad.*agent|NOMAD_(?:SERVER|CLIENT|DATACENTER|DATA_DIR|LOCAL_CONFIG)", needed=(r"(?i)(?:^|[^A-Za-z_])[\"']?acl[\"']?[ \t]*[=:]?[ \t]*\{|NOMAD_ACL_ENABLED[\"']?[ \t]*[:=][ \t]*[\"']?true",), clean="server {\n enabled = true\n}\nacl = {\n enabled = true\n}", comments=SLASH_COMMENT),
    Rule("octoprint_no_access_control", (_nested("accessControl", "enabled", "false"), r"(?i)accessControl[ \t]*:[ \t]*\{[^}]*enabled[ \t]*:[ \t]*false", r"(?i)octoprint[^\n]*--no-access-control|^[^#\n]*--no-access-control\b", setting("OCTOPRINT_ACCESS_CONTROL_ENABLED", NO)), "accessControl:\n  enabled: false", clean="accessControl:\n  enabled: true\naccessControlList: {enabled: false}"),
    Rule("octoprint_first_run_skipped", (r"(?im)^[ \t]*firstRun[ \t]*:[ \t]*false\b",), "server:\n  firstRun: false", unless=(r"(?im)^[ \t]*accessControl[ \t]*:",), clean="server:\n  firstRun: false\naccessControl:\n  enabled: true"),
    Rule("otel_zpages_public", (rf"(?im)^[ \t]+zpages(?:/[\w-]+)?[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+endpoint[ \t]*:[ \t]*[\"']?{ANYWHERE}?:[0-9]+", r"(?is)otel/opentelemetry-collector.*?(?:EXPOSE[^\n]*\b55679\b|[\"' -](?:0\.0\.0\.0:)?[0-9]+:55679)"), "receivers:\n  otlp:\nextensions:\n  zpages:\n    endpoint: 0.0.0.0:55679", unless=(r"(?i)oauth2-proxy|authelia|keycloak-gatekeeper|oidc-proxy|htpasswd|basicauth|nginx\.ingress\.kubernetes\.io/auth-",), clean="extensions:\n  zpages:\n    endpoint: 127.0.0.1:55679\nservice:\n  extensions: [zpages]"),
    Rule("redpanda_no_auth", (rf"(?im)^[ \t]*kafka_api[ \t]*:[ \t]*\n(?:[ \t]*[^\n]*\n)??[ \t]*-?[ \t]*(?:name[ \t]*:[^\n]*\n[ \t]*)?address[ \t]*:[ \t]*[\"']?{ELSEWHERE}", rf"(?i)kafka_api\[[0-9]+\]\.address=[\"']?{ELSEWHERE}", r"(?im)^[ \t]*require_client_auth[ \t]*:[ \t]*false\b", r"(?im)^[ \t]*superusers[ \t]*:"), "redpanda:\n  kafka_api:\n    - address: 0.0.0.0\n      port: 9092", gate=r"(?i)redpanda|kafka_api", unless=(r"(?i)enable_sasl[\"']?[ \t]*[:=][ \t]*[\"']?true|require_client_auth[ \t]*:[ \t]*true",), clean="redpanda:\n  enable_sasl: true\n  kafka_api:\n    - address: 0.0.0.0"),
    Rule("rspamd_controller_weak_password", (r"(?im)^[ \t]*(?:enable_)?password[ \t]*[=:]?[ \t]*[\"']?(?:q1|password|rspamd|admin|changeme)?[\"']?[ \t]*;",), 'worker "controller" {\n bind_socket = "*:11334";\n password = "q1";\n}', gate=r"(?i)controller|rspamd|bind_socket", clean='worker "controller" {\n password = "$2$h7kq";\n}'),
    Rule("rspamd_controller_no_password", (), 'worker "controller" {\n bind_socket = "*:11334";\n}', gate=r"(?is)worker[ \t]+\"?controller\"?[ \t]*\{|bind_socket[^\n]*11334", needed=(r"(?im)^[ \t]*(?:enable_)?password[ \t]*[=:]?[ \t]*[\"']?[^\s\"';]",), clean='worker "controller" {\n password = "$2$h7kq";\n}'),
    Rule("solr_no_auth", (setting("SOLR_JETTY_HOST", ANYWHERE), r"(?i)-D(?:jetty\.)?host=[\"']?(?:0\.0\.0\.0|::|\*)", r"(?is)^\s*\{\s*(?:\"authorization\"[^{]*\{[^{}]*\}\s*,?\s*)?(?:\"authentication\"\s*:\s*\{(?:\s*\"blockUnknown\"\s*:\s*\w+\s*)?\}\s*,?)?\s*(?:\"authorization\"[^{]*\{[^{}]*\}\s*)?\}\s*\z"), "SOLR_JETTY_HOST=0.0.0.0", gate=r"(?i)solr|jetty|\"auth", clean="SOLR_JETTY_HOST=127.0.0.1"),
    Rule("solr_started_open", (r"(?im)bin/solr[ \t]+start\b[^\n]*$", r"(?im)docker[ \t]+run\b[^\n]*\bsolr(?::[\w.-]+)?(?:[ \t]|$)"), "bin/solr start -p 8983", unless=(rf"-D(?:jetty\.)?host=[\"']?{LOOPBACK}", r"-p[ \t]+127\.0\.0\.1:8983", r"security\.json"), clean="bin/solr start -Dhost=127.0.0.1"),
    Rule("spring_actuator_exposed", (r"(?im)management\.endpoints\.web\.exposure\.include[\"']?[ \t]*[:=][ \t]*[\"']?(?:\*|[^\n]*\b(?:env|heapdump|threaddump|loggers|mappings|configprops|beans|jolokia|shutdown|refresh|restart|pause|resume|trace|auditevents)\b)", r"(?im)exposure[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)??[ \t]+include[ \t]*:[ \t]*(?:[\"']?\*|[^\n]*\b(?:env|heapdump|threaddump|loggers|mappings|configprops|beans|jolokia|shutdown)\b|\n(?:[ \t]+-[^\n]*\n)*?[ \t]+-[ \t]*[\"']?(?:\*|env|heapdump|threaddump|shutdown|loggers)\b?)", setting(r"management\.endpoint\.(?:shutdown\.enabled|env\.post\.enabled)", "true"), setting(r"management\.security\.enabled", "false"), setting(r"management\.endpoints\.web\.cors\.allowed-origins", r"\*"), _nested("shutdown", "enabled", "true")), "management.endpoints.web.exposure.include=*", gate=r"(?i)management", clean="management.endpoints.web.exposure.include=health,info\nmanagement.endpoints.web.exposure.exclude=*"),
    Rule("strimzi_listener_no_auth", (r"(?im)^[ \t]+type[ \t]*:[ \t]*[\"']?(?:route|loadbalancer|nodeport|ingress)\b",), "kind: Kafka\nspec:\n  kafka:\n    listeners:\n      - name: a\n        port: 9094\n        type: loadbalancer\n        tls: true", gate=r"(?m)^kind[ \t]*:[ \t]*Kafka[ \t]*$", unless=(r"(?im)^[ \t]+authentication[ \t]*:",), clean="kind: Kafka\nspec:\n  kafka:\n    listeners:\n      - name: a\n        type: internal"),
    Rule("synapse_open_registration", (setting("enable_registration|SYNAPSE_ENABLE_REGISTRATION", YES),), "server_name: a.org\nenable_registration: true", gate=r"(?i)server_name[ \t]*:|/synapse|homeserver\.(?:yaml|pid)|matrix-synapse", unless=(setting("enable_registration_captcha|registration_requires_token", YES), r"(?im)^[ \t]*registrations_require_3pid[ \t]*:[ \t]*(?:\[[ \t]*[^\] \t]|\n[ \t]*-)"), clean="server_name: a.org\nenable_registration: true\nregistration_requires_token: true"),
    Rule("synapse_placeholder_secret", (rf"(?im)^[ \t]*(?:registration_shared_secret|recaptcha_(?:public|private)_key)[ \t]*:[ \t]*(?:[\"']{{2}}|[\"']?(?:{_PLACEHOLDER})[\"']?)?[ \t]*$",), 'server_name: a.org\nregistration_shared_secret: "changeme"', gate=r"(?i)server_name[ \t]*:|/synapse|homeserver\.(?:yaml|pid)|matrix-synapse", clean="server_name: a.org\nregistration_shared_secret: h7Kq29vXwLm3"),
    Rule("synapse_captcha_no_keys", (setting("enable_registration_captcha", YES),), "server_name: a.org\nenable_registration_captcha: true", gate=r"(?i)server_name[ \t]*:|/synapse|homeserver\.(?:yaml|pid)|matrix-synapse", unless=(r"(?is)recaptcha_public_key.*recaptcha_private_key|recaptcha_private_key.*recaptcha_public_key",), clean="server_name: a.org\nenable_registration_captcha: true\nrecaptcha_public_key: a\nrecaptcha_private_key: b"),
    Rule("teleport_second_factor_off", (setting("second_factor", "off|false|no|0|disable|disabled|optional"),), "auth_service:\n  authentication:\n    second_factor: off", gate=r"(?m)^auth_service[ \t]*:", clean="auth_service:\n  authentication:\n    second_factor: otp"),
    Rule("tempo_multitenancy_off", (setting("multitenancy_enabled", NO), r"(?is)auth_enabled[ \t]*:[ \t]*false.*overrides[ \t]*:", r"(?is)overrides[ \t]*:.*auth_enabled[ \t]*:[ \t]*false"), "multitenancy_enabled: false", gate=r"(?i)tempo|distributor|ingester|overrides|multitenancy", clean="multitenancy_enabled: true\noverrides:\n  a: 1"),
    Rule("tempo_shared_without_tenants", (r"(?im)^overrides[ \t]*:", r"(?is)receivers[ \t]*:.*\botlp[ \t]*:.*\b(?:jaeger|zipkin|opencensus)[ \t]*:"), "distributor:\n  receivers:\n    otlp:\n    jaeger:\nstorage:\n  trace: {}", gate=r"(?is)(?:tempo|distributor|ingester)", unless=(setting("multitenancy_enabled|auth_enabled", YES),), clean="distributor:\n  receivers:\n    otlp:\nstorage: {}"),
    Rule("temporal_tls_weak", (setting("disableHostVerification", "true"), setting("requireClientAuth", "false"), r"(?im)^[ \t]*tls[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+frontend[ \t]*:[ \t]*(?:null|~|\{[ \t]*\})[ \t]*$"), "global:\n  tls:\n    frontend:\n      server:\n        requireClientAuth: false", gate=r"(?i)frontend|internode|temporal", clean="global:\n  tls:\n    frontend:\n      server:\n        requireClientAuth: true"),
    Rule("temporal_no_tls", (), "services:\n  frontend:\n    rpc:\n      grpcPort: 7233\n      bindOnIP: 0.0.0.0", gate=r"(?is)frontend[ \t]*:\s*\n\s+rpc[ \t]*:", needed=(r"(?im)^[ \t]+tls[ \t]*:",), unless=(r"(?im)bindOnLocalHost[ \t]*:[ \t]*true", rf"(?im)bindOnIP[ \t]*:[ \t]*[\"']?{LOOPBACK}"), clean="services:\n  frontend:\n    rpc:\n      bindOnIP: 127.0.0.1"),
    Rule("terraform_open_ingress", (rf"(?is)(?:ingress[ \t]*\{{|type[ \t]*=[ \t]*\"ingress\"|aws_vpc_security_group_ingress_rule\"[^{{]*\{{)[^{{}}]*from_port[ \t]*=[ \t]*(?:{_PORTS}|0|-1)\b[^{{}}]*{_WORLD}", rf"(?is)(?:ingress[ \t]*\{{|type[ \t]*=[ \t]*\"ingress\"|aws_vpc_security_group_ingress_rule\"[^{{]*\{{)[^{{}}]*{_WORLD}[^{{}}]*from_port[ \t]*=[ \t]*(?:{_PORTS}|0|-1)\b"), 'resource "aws_security_group" "d" {\n ingress {\n  from_port = 5432\n  to_port = 5432\n  cidr_blocks = ["0.0.0.0/0"]\n }\n}', unless=(r"tfsec:ignore:sg-open|checkov:skip=sg-open",), clean='resource "aws_security_group" "w" {\n ingress {\n  from_port = 443\n  to_port = 443\n  cidr_blocks = ["0.0.0.0/0"]\n }\n egress {\n  from_port = 0\n  cidr_blocks = ["0.0.0.0/0"]\n }\n}', comments=None),
    Rule("thanos_receive_no_tls", (r"(?i)\bthanos[\"',\s]+receive\b", r"(?is)remote_write[ \t]*:.*?url[ \t]*:[ \t]*[\"']?http://[^\n]*(?:thanos|receive)"), "thanos receive --grpc-address=0.0.0.0:10901", unless=(r"(?i)--grpc-server-tls-cert[= ][\"']?[^\s\"']", rf"(?i)--grpc-address[= ][\"']?{LOOPBACK}"), clean="thanos receive --grpc-server-tls-cert=/a --grpc-server-tls-key=/b"),
    Rule("thanos_service_no_tls", (r"(?is)receive[ \t]*:.*type[ \t]*:[ \t]*(?:LoadBalancer|NodePort).*tls[ \t]*:\s*\n\s+enabled[ \t]*:[ \t]*false", r"(?is)receive[ \t]*:.*tls[ \t]*:\s*\n\s+enabled[ \t]*:[ \t]*false.*type[ \t]*:[ \t]*(?:LoadBalancer|NodePort)", r"(?i)--grpc-server-tls-cert=(?:[\"']{2}|[ \t\\]|$)"), "receive:\n  service:\n    type: LoadBalancer\n  tls:\n    enabled: false", clean="receive:\n  service:\n    type: ClusterIP\n  tls:\n    enabled: true"),
    Rule("tor_control_port_open", (r"(?im)^[ \t]*ControlPort[ \t]+(?:[0-9.\[\]:*]*:)?[1-9][0-9]*",), "ControlPort 9051", unless=(r"(?im)^[ \t]*HashedControlPassword[ \t]+16:", r"(?im)^[ \t]*CookieAuthentication[ \t]+1\b"), clean="ControlPort 127.0.0.1:9051\nCookieAuthentication 1"),
    Rule("tor_control_port_public", (r"(?im)^[ \t]*ControlPort[ \t]+(?:0\.0\.0\.0|\*|\[::\]):[0-9]+", r"(?im)^[ \t]*HashedControlPassword[ \t]*(?:[\"']{2}|CHANGEME|TODO|x+|placeholder|replaceme|<[^>\n]*>)?[ \t]*$"), "ControlPort 0.0.0.0:9051\nCookieAuthentication 1", unless=(r"(?im)^[ \t]*HashedControlPassword[ \t]+16:",), clean="ControlPort 9051\nHashedControlPassword 16:872860B76453A77D"),
    Rule("traefik_api_insecure", (r"(?im)--api\.insecure(?:=true|[ \t]+true)?(?:[\s\"',\]]|$)", r"(?im)^[ \t]*\[api\][ \t]*\n(?:[ \t]*[a-z][^\n]*\n)*?[ \t]*insecure[ \t]*=[ \t]*true", r"(?im)^[ \t]*api[ \t]*:[ \t]*(?:\{[^}\n]*insecure[ \t]*:[ \t]*true|\n(?:[ \t]+[^\n]*\n)*?[ \t]+insecure[ \t]*:[ \t]*true)"), "command:\n  - --api.insecure=true", clean="command:\n  - --api.insecure=false\n  - --api.dashboard=true\napi:\n  dashboard: true\n  insecure: false"),
    Rule("traefik_no_redirect", (r"(?im)^[ \t]*address[ \t]*[:=][ \t]*[\"']?:(?:80|8080)[\"']?[ \t]*(?:/tcp)?[ \t]*$", r"(?i)--entrypoints\.[\w-]+\.address=[\"']?:(?:80|8080)(?:[\s\"',\]]|$)"), 'entryPoints:\n  web:\n    address: ":80"\n  websecure:\n    address: ":443"', gate=r"(?i)entrypoints", unless=(r"(?i)redirections",), clean='entryPoints:\n  web:\n    address: ":80"\n    http:\n      redirections:\n        entryPoint:\n          to: websecure'),
    Rule("unbound_control_public", (rf"(?im)^[ \t]*control-interface[ \t]*:[ \t]*(?:{ELSEWHERE}|::0)", r"(?im)^[ \t]*control-use-cert[ \t]*:[ \t]*no\b", rf"(?i)unbound-control\b[^\n]*[ \t]-s[ \t]+{ELSEWHERE}"), "remote-control:\n  control-enable: yes\n  control-interface: 0.0.0.0", unless=(r"(?im)^[ \t]*control-enable[ \t]*:[ \t]*no\b",), clean="remote-control:\n  control-enable: yes\n  control-interface: 127.0.0.1\n  control-use-cert: yes"),
    Rule("uwsgi_stats_public", (rf"(?im)^[ \t]*[\"']?stats(?:[-_]server)?[\"']?[ \t]*[:=][ \t]*[\"']?(?:tcp://)?(?:{ELSEWHERE}:?|::)?:?[0-9]{{2,5}}[\"']?[ \t]*$", rf"(?i)--stats(?:-server)?[= ][\"']?(?:{ELSEWHERE}|::)?:?[0-9]{{2,5}}(?:[\s\"',\]]|$)", r"(?im)--stats(?:-server)?[\"'],[ \t]*[\"'](?:0\.0\.0\.0|\*)?:[0-9]+"), "[uwsgi]\nstats = 0.0.0.0:9191", gate=r"(?i)uwsgi|stats-server", clean="[uwsgi]\nstats = 127.0.0.1:9191\nstats = /tmp/s.sock"),
    Rule("weaviate_anonymous", (r"(?im)AUTHENTICATION_ANONYMOUS_ACCESS_ENABLED[\"']?[ \t]*[:=][ \t]*[\"']?(?:true|1|yes|on)\b", _nested("anonymous_access", "enabled", "true")), "AUTHENTICATION_ANONYMOUS_ACCESS_ENABLED: 'true'", unless=(r"(?i)AUTHENTICATION_(?:APIKEY|OIDC)_ENABLED[\"']?[ \t]*[:=][ \t]*[\"']?(?:true|1|yes|on)\b",), clean="AUTHENTICATION_ANONYMOUS_ACCESS_ENABLED=true\nAUTHENTICATION_APIKEY_ENABLED=true", comments=SLASH_COMMENT),
    Rule("woodpecker_weak_secret", (r"(?im)^[ \t]*(?:-[ \t]*|export[ \t]+)?[\"']?WOODPECKER_(?:AGENT_|SERVER_)?SECRET[\"']?[ \t]*[:=][ \t]*(?:[\"']{2}|[\"']?[^\s\"'$]{1,15}[\"']?)?[ \t]*$", r"(?im)^[ \t]*agent[ \t]*:[ \t]*\n(?:[ \t]+[^\n]*\n)*?[ \t]+secret[ \t]*:[ \t]*(?:[\"']{2}|[\"']?[^\s\"'$]{1,15}[\"']?)?[ \t]*$"), "WOODPECKER_AGENT_SECRET=changeme", gate=r"(?i)woodpecker", clean="WOODPECKER_AGENT_SECRET=h7Kq29vXwLm3h7Kq29vX"),
    Rule("woodpecker_no_secret", (r"(?i)woodpeckerci/woodpecker-[a-z]+", r"(?im)^[ \t]*(?:-[ \t]*)?WOODPECKER_(?:HOST|GRPC_ADDR|SERVER)[\"']?[ \t]*[:=][ \t]*[\"']?(?:https?://)?[a-km-z0]"), "image: woodpeckerci/woodpecker-agent:v2", unless=(r"(?i)WOODPECKER_(?:AGENT_|SERVER_)?SECRET|(?m)^[ \t]+secret[ \t]*:",), clean="image: woodpeckerci/woodpecker-agent:v2\nWOODPECKER_AGENT_SECRET=h7Kq29vXwLm3h7Kq29vX"),
    Rule("wordpress_debug_display", (r"(?i)define\s*\(\s*['\"]WP_DEBUG['\"]\s*,\s*['\"]?(?:true|1)['\"]?\s*\)",), "define('WP_DEBUG', true);", unless=(r"(?i)['\"]WP_DEBUG_DISPLAY['\"]\s*,\s*['\"]?(?:false|0)",), gate=r"(?is)WP_DEBUG['\"]", clean="define('WP_DEBUG', true);\ndefine('WP_DEBUG_DISPLAY', false);", comments=SLASH_COMMENT),
    # program code
    Rule("python_os_system_input", (r"\b(?:os\.(?:system|popen[234]?)|commands\.get(?:status)?output|popen2\.popen[234])\s*\(\s*[fF][rR]?[\"'][^\n]*\{", r"\b(?:os\.(?:system|popen[234]?)|commands\.get(?:status)?output|popen2\.popen[234])\s*\([^\n]*[\"']\s*(?:\+|%)\s*[A-Za-z_(]", r"\b(?:os\.(?:system|popen[234]?)|commands\.get(?:status)?output|popen2\.popen[234])\s*\([^\n]*[A-Za-z_\])]\s*\+\s*[\"']", r"\b(?:os\.(?:system|popen[234]?)|commands\.get(?:status)?output|popen2\.popen[234])\s*\([^\n]*[\"']\.format\s*\("), 'os.system(f"ping -c 1 {host}")', clean='os.system("uptime")\nsubprocess.run(["ping", host])', comments=r"(?s:\"\"\".*?\"\"\")|(?s:'''.*?''')|(?m:(?:^|[ \t])#[^\n]*$)"),
    Rule("snobol_dynamic_code", (r"(?im)(?:^|[^A-Za-z0-9_.'\"])(?:CODE|EVAL|APPLY|LOAD)\s*\(",), "        OBJ = CODE(SRC)", clean="* CODE(X) in a comment\n        CODES(X)\n        OUTPUT = 'EVAL(X)'", comments=r"(?m:^\*[^\n]*$)|\"[^\"\n]*\"|'[^'\n]*'"),
    Rule("python_xml_entities", (r"\bxml\.(?:etree\.(?:c?ElementTree)\.(?:parse|fromstring|iterparse|XML|XMLParser)|dom\.(?:minidom|pulldom)\.(?:parse|parseString)|sax\.(?:parse|parseString|make_parser)|parsers\.expat\.ParserCreate)\s*\(", r"(?:^|[^A-Za-z0-9_.])(?:ET|ElementTree|etree|minidom|pulldom)\.(?:parse|fromstring|iterparse|XML|parseString|XMLParser)\s*\(", r"\blxml\.etree\.(?:parse|fromstring|XML|iterparse)\s*\("), "import xml.etree.ElementTree as ET\nET.parse(p)", unless=(r"(?m)^\s*(?:import|from)\s+defusedxml", r"resolve_entities\s*=\s*False"), clean="import defusedxml.ElementTree as ET\nET.parse(p)", comments=PYTHON),
]
