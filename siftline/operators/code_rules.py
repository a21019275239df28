"""Rules for generated program code.

Strings and comments are masked by one pattern a language family, read from left
to right, so that a comment mark inside a string or a quote inside a comment is
no mistake; a call whose argument was a literal is left with none.  Fixed values:
the names of the dangerous calls.
"""

from __future__ import annotations

from ..functions.rules import Rule

_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\.)*"', r"'(?:[^'\\\n]|\\.)*'"
C_LIKE = rf"{_DOUBLE}|{_SINGLE}|//[^\n]*|(?s:/\*.*?\*/)"
HASH = rf"{_DOUBLE}|{_SINGLE}|#[^\n]*"
PYTHON = rf'(?s:""".*?""")|(?s:\'\'\'.*?\'\'\')|{HASH}'
DASHES = rf"{_DOUBLE}|{_SINGLE}|--[^\n]*"
SEMICOLON = rf"{_DOUBLE}|;[^\n]*"
PERCENT = rf"{_DOUBLE}|%[^\n]*"
PAREN_STAR = rf"{_DOUBLE}|(?s:\(\*.*?\*\))"
PHP = rf"{C_LIKE}|#[^\n]*"

_DYNAMIC = r"\s*\(\s*[^)\s]"  # an argument that was no literal


def _call(names: str) -> str:
    return rf"(?:^|[^A-Za-z0-9_.$])(?:{names}){_DYNAMIC}"


def _method(names: str) -> str:
    return rf"\.\s*(?:{names}){_DYNAMIC}"


def _word(names: str) -> str:
    """A shell-like command followed by an expansion."""
    return rf"(?m)(?:^|[;&|({{]\s*)(?:{names})[ \t]+[^\n]*[$`]"


def _form(names: str) -> str:
    """A Lisp form whose argument is no literal."""
    return rf"\(\s*(?:{names})\s+[^\s)]"


_SHELL_COMMENT = r"(?m)(?:^|[ \t])#[^\n]*$|'[^'\n]*'"


def _shell(name: str, names: str, probe: str) -> Rule:
    return Rule(name, (_word(names),), probe, comments=_SHELL_COMMENT)


CODE_RULES = [
    # shells
    *(_shell(f"{n}_eval", "eval", 'eval "$cmd"') for n in "bash dash ksh mksh yash zsh tcsh fish elvish oil murex rc".split()),
    _shell("fish_source", r"source|\.", "source $file"),
    _shell("nushell_source", "source(?:-env)?|nu -c", "source $path"),
    Rule("shell_unquoted_variable", (r"(?m)^[ \t]*(?:rm|cp|mv|cd|cat|mkdir|chmod)[ \t][^\n\"]*(?:^|[ \t])\$[A-Za-z_{]",), "rm -rf $dir", comments=_SHELL_COMMENT),
    Rule("sed_execute_flag", (r"\bsed\b[^\n]*s(?:/[^/\n]*){2}/[a-z]*e\b",), "sed 's/a/b/e' x", comments=None),
    Rule("awk_system", (r"\bsystem\s*\(\s*[^)\s]", r"\|\s*getline\b"), "{ system(cmd $1) }", comments=HASH),
    Rule("xonsh_execx", (_call("execx|evalx"),), "execx(s)", comments=PYTHON),
    # Lisps
    Rule("clojure_eval", (_form("eval|load-string|read-string"),), "(eval (read-string s))", comments=SEMICOLON),
    Rule("clojure_with_redefs", (r"\(\s*with-redefs(?:-fn)?\b",), "(with-redefs [f g] (h))", comments=SEMICOLON),
    Rule("common_lisp_eval", (_form("eval|compile|load|read-from-string"),), "(eval (read-from-string s))", comments=SEMICOLON),
    Rule("elisp_eval", (_form("eval|eval-region|eval-buffer|eval-string|load-file"),), "(eval form)", comments=SEMICOLON),
    Rule("fennel_eval", (_form(r"eval|eval-compiler|fennel\.eval|fennel\.dofile"),), "(fennel.eval s)", comments=SEMICOLON),
    Rule("hy_eval", (_form("eval|hy.eval|exec|read-str"),), "(eval form)", comments=SEMICOLON),
    Rule("janet_eval", (_form("eval|eval-string|dofile"),), "(eval-string s)", comments=HASH),
    Rule("picolisp_eval", (_form("eval|run|load"),), "(eval X)", comments=HASH),
    Rule("racket_eval", (_form("eval|eval-syntax|dynamic-require|load"),), "(eval form ns)", comments=SEMICOLON),
    Rule("scheme_eval", (_form("eval|load"),), "(eval form env)", comments=SEMICOLON),
    # scripting languages
    Rule("lua_loadstring", (_call("loadstring|load|dofile"), r":dostring\s*\("), "loadstring(s)()", comments=DASHES),
    Rule("lua_pcall_discarded", (r"(?m)^[ \t]*x?pcall\s*\(",), "pcall(f)", comments=DASHES),
    Rule("moonscript_loadstring", (r"(?:^|[^A-Za-z_.])(?:loadstring|load)[ \t(]+[A-Za-z_]",), "loadstring src", comments=DASHES),
    Rule("perl_eval_string", (r"(?m)\beval\s+\$|\beval\s*\(\s*\$",), "eval $code;", comments=r"(?m)#[^\n]*$"),
    Rule("perl_backtick", (r"`[^`\n]*\$[A-Za-z_][^`\n]*`", r"\bqx\s*[{/(][^})\n]*\$"), "my $x = `ls $dir`;", comments=r"(?m)^[ \t]*#[^\n]*$"),
    Rule("perl_do_file", (r"\b(?:do|require)\s+\$[A-Za-z_]",), "do $file;", comments=r"(?m)#[^\n]*$"),
    Rule("raku_eval", (r"\bEVAL\b", r"MONKEY-SEE-NO-EVAL"), "use MONKEY-SEE-NO-EVAL; EVAL $s;", comments=None),
    Rule("php_eval", (_call("eval|create_function|assert"), r"preg_replace\s*\([^,)]*/e"), "eval($x);", comments=PHP),
    Rule("php_include_input", (r"\b(?:include|include_once|require|require_once)\b\s*\(?\s*\$(?:_GET|_POST|_REQUEST|_COOKIE|[a-z_]+)",), "include $_GET['p'];", comments=PHP),
    Rule("php_file_read", (r"\b(?:file_get_contents|fopen|readfile|file|unlink)\s*\(\s*\$_(?:GET|POST|REQUEST)",), "readfile($_GET['f']);", comments=PHP),
    Rule("php_unserialize", (r"\bunserialize\s*\(\s*\$",), "unserialize($data);", comments=PHP),
    Rule("php_curl_verify", (r"CURLOPT_SSL_VERIFY(?:PEER|HOST)\s*,\s*(?:false|0)", r"CURLOPT_SSL_VERIFY(?:PEER|HOST)\s*=>\s*(?:false|0)"), "curl_setopt($c, CURLOPT_SSL_VERIFYPEER, false);", comments=PHP),
    Rule("php_mysqli_concat", (r"(?:mysqli_query|->query)\s*\([^;\n]*\.\s*\$",), "mysqli_query($c, \"SELECT\" . $id);", comments=r"(?m)//[^\n]*$"),
    Rule("php_loose_equality", (r"[^=!<>]==[^=]|!=[^=]|<>",), "if ($a == $b) {}", comments=PHP),
    Rule("ruby_eval_string", (r"\b(?:instance_eval|class_eval|module_eval|eval)\s*[( ]\s*[a-z_@$]",), "eval code", comments=HASH),
    Rule("ruby_open_uri", (r"\b(?:URI\.open|open)\s*\(\s*(?:params|[a-z_]*url)\b",), "URI.open(params[:u])", comments=HASH),
    Rule("ruby_rescue_bare", (r"(?m)^[ \t]*rescue[ \t]*(?:=>[^\n]*)?$", r"\brescue\s+Exception\b"), "begin\n x\nrescue\n y\nend", comments=HASH),
    Rule("r_eval_parse", (r"\beval\s*\(\s*(?:parse|str2lang|str2expression)\s*\(",), "eval(parse(text = s))", comments=HASH),
    Rule("julia_eval", (_call("eval|include_string"), r"@eval\b", r"\bMeta\.parse\s*\("), "eval(Meta.parse(s))", comments=HASH),
    Rule("julia_include_string", (r"\binclude_string\s*\(",), "include_string(Main, s)", comments=HASH),
    Rule("tcl_eval", (r"(?m)(?:^|[\[;{]\s*)(?:eval|uplevel)\s+[^\n]*\$",), "eval $cmd", comments=r"(?m)^[ \t]*#[^\n]*$"),
    Rule("tcl_subst", (r"(?m)(?:^|[\[;{]\s*)subst\s+[^\n]*\$",), "subst $tpl", comments=r"(?m)^[ \t]*#[^\n]*$"),
    Rule("powershell_iex", (r"(?i)(?:^|[^A-Za-z-])(?:Invoke-Expression|iex)\b",), "Invoke-Expression $c", comments=HASH),
    Rule("vbscript_execute", (r"(?im)(?:^|[^A-Za-z.])(?:Execute|ExecuteGlobal|Eval)\s*[( ]\s*[A-Za-z(]",), "ExecuteGlobal code", comments=rf"{_DOUBLE}|'[^\n]*"),
    Rule("vimscript_execute", (r"(?m)^[ \t]*(?::?exe(?:c(?:u(?:te?)?)?)?)[ \t]+[a-z:]*[A-Za-z]", r"\beval\s*\(\s*[a-z]"), "execute l:cmd", comments=r"(?m)^[ \t]*\"[^\n]*$|'[^'\n]*'"),
    Rule("applescript_run_script", (r"(?i)\brun script\s+[^\"\s]", r"(?i)\bdo shell script\s+[^\n]*&"), "run script theCode", comments=DASHES),
    Rule("rexx_interpret", (r"(?im)^[ \t]*interpret[ \t]+[^\s]",), "interpret cmd", comments=C_LIKE),
    Rule("mumps_xecute", (r"(?im)(?:^|[ \t])(?:XECUTE|X)[ \t]+[A-Za-z@]",), " XECUTE code", comments=SEMICOLON),
    Rule("rebol_do", (r"(?im)(?:^|[\[ \t])do[ \t]+(?:load[ \t]+)?[a-z]",), "do load code", comments=SEMICOLON),
    Rule("red_do", (r"(?im)(?:^|[\[ \t])(?:do|load)[ \t]+[a-z]",), "do code", comments=SEMICOLON),
    Rule("smalltalk_evaluate", (r"(?:Compiler|Smalltalk compiler)\s+evaluate:\s*[A-Za-z]", r"\bevaluate:\s*[a-z]"), "Compiler evaluate: src", comments=r"\"[^\"]*\"|'[^']*'"),
    Rule("groovy_evaluate", (r"\b(?:Eval\.(?:me|x|xy|xyz))\s*\(\s*[^)\s]", _method("evaluate|parseClass")), "Eval.me(s)", comments=C_LIKE),
    Rule("groovy_shell_execute", (r"[A-Za-z_\"']\.execute\s*\(\s*\)",), 'cmd.execute()', comments=r"(?m)//[^\n]*$"),
    Rule("coldfusion_execute", (r"(?i)<cfexecute\b", r"(?i)\bevaluate\s*\(\s*[^)\s]"), "<cfexecute name=\"x\">", comments=r"(?s)<!---.*?--->"),
    Rule("coffee_eval", (r"(?:^|[^A-Za-z0-9_.])eval[ \t(]+[a-z]", r"vm\.runIn(?:This|New)Context"), "eval code", comments=HASH),
    Rule("haxe_reflect", (r"\bReflect\.(?:callMethod|field|setField)\s*\(", r"\bType\.createInstance\s*\("), "Reflect.callMethod(o, f, a);", comments=C_LIKE),
    Rule("wren_meta", (r"\bMeta\.(?:eval|compile)\s*\(",), "Meta.eval(s)", comments=C_LIKE),
    Rule("squirrel_compilestring", (r"\bcompilestring\s*\(",), "compilestring(s)()", comments=C_LIKE),
    Rule("pike_compile_string", (r"\bcompile_string\s*\(", r"\bcompile_file\s*\("), "compile_string(s);", comments=C_LIKE),
    Rule("io_dostring", (r"\bdoString\s*\(", r"\bdoFile\s*\("), "Lobby doString(s)", comments=PHP),
    Rule("chuck_machine", (r"\bMachine\.(?:add|replace|spork|eval)\s*\(",), "Machine.add(f);", comments=C_LIKE),
    Rule("forth_evaluate", (r"(?i)(?:^|\s)(?:EVALUATE|INTERPRET|INCLUDED)(?:\s|$)",), "s EVALUATE", comments=r"(?m)\\ [^\n]*$"),
    Rule("factor_eval", (r"(?:^|\s)(?:eval\(|\(eval\)|eval>string|parse-string)",), "str eval( -- x )", comments=r"(?m)! [^\n]*$"),
    Rule("postscript_exec", (r"(?m)(?:^|\s)(?:cvx\s+exec|token|run|filenameforall)(?:\s|$)",), "str cvx exec", comments=PERCENT),
    Rule("prolog_call", (r"\b(?:call|assert[az]?|retract(?:all)?)\s*\(\s*[A-Z_]",), "p(X) :- call(X).", comments=PERCENT),
    Rule("erlang_eval", (r"\berl_eval:exprs?\s*\(", r"\bcompile:forms\s*\(", r"\berl_scan:string\s*\("), "erl_eval:exprs(E, B).", comments=PERCENT),
    Rule("elixir_code_eval", (r"\bCode\.(?:eval_string|eval_quoted|eval_file|compile_string|string_to_quoted)\s*[( ]",), "Code.eval_string(s)", comments=HASH),
    Rule("elixir_ecto_fragment", (r"\bfragment\s*\([^)\n]*#\{", r"\bRepo\.query!?\s*\(\s*[a-z]"), "Repo.query(sql)", comments=r"(?m)#[ ][^\n]*$"),
    Rule("elixir_sleep_in_server", (r"\bProcess\.sleep\s*\(", r":timer\.sleep\s*\("), "def handle_call(a, b, c) do\n Process.sleep(9)", gate=r"\bhandle_(?:call|cast|info)\b", comments=HASH),
    Rule("octave_eval", (_call("eval|evalin|feval|assignin"),), "eval(s)", comments=PERCENT),
    Rule("mathematica_to_expression", (r"\bToExpression\s*\[\s*[^\]\s]", r"(?m)^[ \t]*<<[ \t]*[A-Za-z]"), "ToExpression[s]", comments=PAREN_STAR),
    Rule("maxima_ev", (r"\b(?:eval_string|parse_string|batchload|system)\s*\(\s*[^)\s]",), "eval_string(s);", comments=C_LIKE),
    Rule("gap_evalstring", (r"\b(?:EvalString|ReadAsFunction)\s*\(\s*[^)\s]",), "EvalString(s);", comments=HASH),
    Rule("gnuplot_system", (r"(?m)^[ \t]*(?:system|!)[ \t]+[^\s\"']", r"\bsystem\s*\(\s*[^)\s]"), "system(cmd)", comments=HASH),
    Rule("m4_esyscmd", (r"\b(?:m4_)?(?:esyscmd|syscmd)\s*\(",), "esyscmd(`ls')", comments=r"(?m)\bdnl\b[^\n]*$"),
    Rule("tex_write18", (r"\\(?:immediate\s*)?\\?write18\b", r"\\directlua\s*\{[^}\n]*os\.execute"), "\\immediate\\write18{ls}", comments=r"(?m)%[^\n]*$"),
    # compiled languages
    Rule("ada_spawn", (r"(?i)\bGNAT\.OS_Lib\.(?:Spawn|Non_Blocking_Spawn)\b",), "GNAT.OS_Lib.Spawn (P, A, S);", comments=DASHES),
    Rule("c_unbounded_copy", (r"\b(?:strcpy|strcat|sprintf|vsprintf|gets)\s*\(",), "strcpy(a, b);", comments=C_LIKE),
    Rule("c_malloc_no_free", (r"\b(?:malloc|calloc|realloc|strdup)\s*\(",), "p = malloc(9);", unless=(r"\bfree\s*\(",), gate=r"\b(?:malloc|calloc|realloc|strdup)\s*\(", comments=C_LIKE, clean='p = malloc(9);\nfree(p);'),
    Rule("d_mixin", (r"\bmixin\s*\(\s*[^)\s]",), "mixin(code);", comments=C_LIKE),
    Rule("nim_static_exec", (r"\b(?:staticExec|gorge|gorgeEx|execShellCmd)\s*\(?",), "staticExec(cmd)", comments=HASH),
    Rule("crystal_macro_run", (r"\{\{\s*(?:run|system)\s*\(", r"\{\{\s*`"), "{{ run(x) }}", comments=HASH),
    Rule("zig_undefined", (r"=\s*undefined\s*;",), "var x: u8 = undefined;", comments=C_LIKE),
    Rule("csharp_async_void", (r"\basync\s+void\s+[A-Za-z_]",), "async void Go() {}", comments=C_LIKE),
    Rule("csharp_binary_formatter", (r"\bnew\s+(?:BinaryFormatter|NetDataContractSerializer|SoapFormatter|LosFormatter|ObjectStateFormatter)\s*\(",), "new BinaryFormatter().Deserialize(s);", comments=C_LIKE),
    Rule("csharp_cert_bypass", (r"ServerCertificate(?:Custom)?ValidationCallback\s*\+?=[^;]*=>\s*true", r"DangerousAcceptAnyServerCertificateValidator"), "h.ServerCertificateCustomValidationCallback = (a, b, c, d) => true;", comments=C_LIKE),
    Rule("csharp_open_redirect", (r"\bRedirect(?:Permanent)?\s*\(\s*(?:returnUrl|url|Request\.)",), "return Redirect(returnUrl);", unless=(r"IsLocalUrl|LocalRedirect",), gate=r"\bRedirect", comments=C_LIKE, clean='if (Url.IsLocalUrl(returnUrl)) return Redirect(returnUrl);'),
    Rule("csharp_sql_concat", (r"new\s+SqlCommand\s*\([^;\n]*\+\s*[a-z]", r"CommandText\s*=[^;\n]*\+\s*[a-z]"), "new SqlCommand(\"a\" + id, c);", comments=r"(?m)//[^\n]*$"),
    Rule("csharp_xxe", (r"DtdProcessing\s*=\s*DtdProcessing\.Parse", r"XmlResolver\s*=\s*new\s+XmlUrlResolver"), "s.DtdProcessing = DtdProcessing.Parse;", comments=C_LIKE),
    Rule("fsharp_reflection", (r"\.GetMethod\s*\(", r"\.InvokeMember\s*\(", r"\bActivator\.CreateInstance\s*\("), "t.GetMethod(n).Invoke(o, a)", comments=C_LIKE),
    Rule("go_exec_shell", (r"exec\.Command(?:Context)?\s*\([^)\n]*\"(?:sh|bash|cmd)\"[^)\n]*\"(?:-c|/C)\"",), 'exec.Command("sh", "-c", s)', comments=r"(?m)//[^\n]*$"),
    Rule("go_sprintf_sql", (r"fmt\.Sprintf\s*\(\s*\"(?i:select|insert|update|delete)\b",), 'fmt.Sprintf("SELECT %s", x)', comments=r"(?m)//[^\n]*$"),
    Rule("go_template_raw", (r"\btemplate\.(?:HTML|JS|URL|CSS|HTMLAttr)\s*\(\s*[^)\s]",), "template.HTML(s)", comments=C_LIKE),
    Rule("go_error_ignored", (r"(?m)^[ \t]*[A-Za-z_0-9]+\s*,\s*_\s*:?=\s*[A-Za-z_.]+\s*\(",), "v, _ := f(x)", comments=C_LIKE),
    Rule("go_defer_in_loop", (r"(?s)\bfor\b[^{}]*\{[^{}]*\bdefer\b",), "for _, f := range x {\n defer f.Close()\n}", comments=C_LIKE),
    Rule("go_background_in_handler", (r"\bcontext\.(?:Background|TODO)\s*\(\s*\)",), "func h(w http.ResponseWriter, r *http.Request) { context.Background() }", gate=r"http\.ResponseWriter", comments=C_LIKE),
    Rule("go_mutex_by_value", (r"\bfunc\s*(?:\([^)]*\))?\s*[A-Za-z_]*\s*\([^)*]*\bsync\.(?:RW)?Mutex\b",), "func f(m sync.Mutex) {}", comments=C_LIKE),
    Rule("go_open_redirect", (r"http\.Redirect\s*\([^)\n]*r\.(?:URL\.Query|FormValue)",), "http.Redirect(w, r, r.FormValue(x), 302)", comments=C_LIKE),
    Rule("grpc_no_tls", (r"grpc\.(?:WithInsecure|insecure_channel)\s*\(", r"insecure\.NewCredentials\s*\(", r"add_insecure_port\s*\("), "grpc.WithInsecure()", comments=C_LIKE),
    Rule("haskell_unsafe_io", (r"\bunsafe(?:PerformIO|DupablePerformIO|InterleaveIO|Coerce)\b",), "x = unsafePerformIO y", comments=DASHES),
    Rule("haskell_interpret", (r"\b(?:runInterpreter|interpret|eval)\s+[a-z]",), "r <- interpret s", gate=r"Language\.Haskell\.Interpreter|interpret|runInterpreter", comments=DASHES),
    Rule("ocaml_obj_magic", (r"\bObj\.(?:magic|repr|obj|set_field)\b",), "Obj.magic x", comments=PAREN_STAR),
    Rule("java_empty_catch", (r"\bcatch\s*\([^)]*\)\s*\{\s*\}",), "try { x(); } catch (Exception e) {}", comments=None),
    Rule("java_ldap_concat", (r"\.search\s*\([^;\n]*\+\s*[a-z]",), "ctx.search(b, \"(uid=\" + u + \")\", c);", comments=r"(?m)//[^\n]*$"),
    Rule("java_log_injection", (r"\blog(?:ger)?\.(?:info|warn|error|debug)\s*\([^;\n]*\+\s*(?:request|req|param|user)",), "logger.info(\"x\" + request.getParameter(p));", comments=r"(?m)//[^\n]*$"),
    Rule("java_runtime_exec", (r"getRuntime\s*\(\s*\)\s*\.exec\s*\([^;\n]*\+", r"new\s+ProcessBuilder\s*\([^;\n]*\+"), "Runtime.getRuntime().exec(\"a\" + b);", comments=r"(?m)//[^\n]*$"),
    Rule("java_spel", (r"\.parseExpression\s*\(\s*[^)\s]",), "p.parseExpression(s);", comments=C_LIKE),
    Rule("java_concat_loop", (r"(?s)\b(?:for|while)\b[^{}]*\{[^{}]*\b[a-z][A-Za-z]*\s*\+=\s*[a-z\"]",), "for (;;) { out += s; }", comments=r"(?m)//[^\n]*$"),
    Rule("java_xxe", (r"\b(?:SAXParserFactory|DocumentBuilderFactory|XMLInputFactory)\.newInstance\s*\(",), "SAXParserFactory.newInstance();", unless=(r"disallow-doctype-decl|FEATURE_SECURE_PROCESSING|SUPPORT_DTD",), gate=r"(?:SAXParserFactory|DocumentBuilderFactory|XMLInputFactory)\.newInstance", comments=None, clean='f = SAXParserFactory.newInstance();\nf.setFeature("http://apache.org/xml/features/disallow-doctype-decl", true);'),
    Rule("kotlin_global_scope", (r"\bGlobalScope\.(?:launch|async|future|actor|produce)\b",), "GlobalScope.launch { }", comments=C_LIKE),
    Rule("kotlin_not_null", (r"[A-Za-z_)\]]!!",), "val x = y!!.z", comments=C_LIKE),
    Rule("kotlin_run_blocking", (r"(?s)\bsuspend\s+fun\b.*?\brunBlocking\b",), "suspend fun f() { runBlocking { } }", comments=C_LIKE),
    Rule("kotlin_trust_all", (r"\bhostnameVerifier\s*\{[^}]*true\s*\}", r"(?s)\bcheckServerTrusted\s*\([^)]*\)\s*\{\s*\}"), "b.hostnameVerifier { _, _ -> true }", comments=C_LIKE),
    Rule("kotlin_runtime_exec", (r"getRuntime\(\)\.exec\s*\([^)\n]*(?:\+|\$)",), "Runtime.getRuntime().exec(\"ls $d\")", comments=r"(?m)//[^\n]*$"),
    Rule("kotlin_intent_redirect", (r"getParcelableExtra[^\n]*Intent", r"\bstartActivity\s*\(\s*intent\.get"), "startActivity(intent.getParcelableExtra(k))", comments=C_LIKE),
    Rule("dart_late", (r"(?m)^[ \t]*late\s+(?:final\s+)?[A-Z][A-Za-z<>?]*\s+[a-z_][A-Za-z0-9_]*\s*;",), "late String name;", comments=C_LIKE),
    Rule("dart_mirrors", (r"\breflect(?:Class|Type)?\s*\(", r"\.invoke\s*\(\s*Symbol"), "reflect(o).invoke(Symbol(n), []);", comments=C_LIKE),
    Rule("rust_unwrap", (r"\.unwrap\s*\(\s*\)", r"\.expect\s*\("), "x.unwrap();", comments=C_LIKE),
    Rule("rust_transmute", (r"\btransmute(?:::<[^>]*>)?\s*\(",), "std::mem::transmute(x)", comments=C_LIKE),
    Rule("rust_unchecked_utf8", (r"\bfrom_utf8_unchecked\s*\(",), "str::from_utf8_unchecked(b)", comments=C_LIKE),
    Rule("rust_block_on", (r"(?s)\basync\s+fn\b.*?\bblock_on\s*\(",), "async fn f() { block_on(g()); }", comments=C_LIKE),
    Rule("rust_command_shell", (r"Command::new\s*\(\s*\"(?:sh|bash|cmd)\"\s*\)",), 'Command::new("sh").arg("-c").arg(s)', comments=r"(?m)//[^\n]*$"),
    Rule("rust_unsafe_no_comment", (r"\bunsafe\s*\{",), "unsafe { f() }", unless=(r"(?i)SAFETY:",), gate=r"\bunsafe\s*\{", comments=None, clean='// SAFETY: checked above\nunsafe { f() }'),
    Rule("scala_null_return", (r"\breturn\s+null\b", r"=\s*null\s*$"), "return null", comments=C_LIKE),
    Rule("scala_toolbox", (r"\bmkToolBox\s*\(", r"\btoolbox\.(?:eval|parse|compile)\s*\("), "cm.mkToolBox().eval(t)", comments=C_LIKE),
    Rule("scala_blocking_actor", (r"\b(?:Await\.(?:result|ready)|Thread\.sleep)\s*\(",), "class A extends Actor { def receive = { case x => Await.result(f, d) } }", gate=r"\bdef\s+receive\b", comments=C_LIKE),
    Rule("swift_webview_js", (r"\bjavaScriptEnabled\s*=\s*true\b", r"\.evaluateJavaScript\s*\(\s*[^)\s]"), "p.javaScriptEnabled = true", comments=C_LIKE),
    # the web
    Rule("js_eval", (_call("eval"), r"\bnew\s+Function\s*\(\s*[^)\s]"), "eval(code)", comments=C_LIKE),
    Rule("js_loose_equality", (r"[^=!<>]==[^=]|[^!]!=[^=]",), "if (a == b) {}", comments=C_LIKE),
    Rule("node_child_process", (r"\b(?:exec|execSync)\s*\([^;\n]*(?:\+|\$\{)",), "exec('ls ' + d)", comments=r"(?m)//[^\n]*$"),
    Rule("node_jwt_no_algorithm", (r"\bjwt\.verify\s*\(\s*[^,)]+,\s*[^,)]+\)",), "jwt.verify(t, k)", comments=C_LIKE),
    Rule("node_mongo_where", (r"\$where\b",), "db.find({$where: f})", comments=C_LIKE),
    Rule("node_vm", (r"\bvm\.(?:runInContext|runInNewContext|runInThisContext)\s*\(\s*[^)\s]", r"\bnew\s+vm\.Script\s*\(\s*[^)\s]"), "vm.runInNewContext(s)", comments=C_LIKE),
    Rule("express_cookie_insecure", (r"\bsecure\s*:\s*false\b", r"\bhttpOnly\s*:\s*false\b"), "cookie: { secure: false }", comments=C_LIKE),
    Rule("express_cors_reflect", (r"Access-Control-Allow-Origin['\"]\s*,\s*req\.(?:headers\.origin|get\()", r"\borigin\s*:\s*true\b"), "res.set('Access-Control-Allow-Origin', req.headers.origin)", comments=r"(?m)//[^\n]*$"),
    Rule("flask_cors_all", (r"\bCORS\s*\(\s*app\s*\)", r"origins\s*=\s*['\"]\*['\"]"), "CORS(app)", comments=r"(?m)#[^\n]*$"),
    Rule("flask_debug", (r"\.run\s*\([^)\n]*debug\s*=\s*True", r"config\[['\"]DEBUG['\"]\]\s*=\s*True"), "app.run(debug=True)", comments=r"(?m)#[^\n]*$"),
    Rule("next_secret_leak", (r"(?s)\bget(?:ServerSide|Static)Props\b.*?process\.env\.[A-Z_]*(?:SECRET|KEY|TOKEN|PASSWORD)",), "export async function getServerSideProps() { return { props: { k: process.env.API_SECRET } } }", comments=C_LIKE),
    Rule("react_key_index", (r"\bkey=\{\s*(?:index|idx|i)\s*\}",), "<li key={index}>", comments=None),
    Rule("react_inner_html_prop", (r"dangerouslySetInnerHTML=\{\{\s*__html:\s*(?:props|this\.props|[a-z]+)",), "<div dangerouslySetInnerHTML={{ __html: props.h }} />", comments=None),
    Rule("typescript_any", (r":\s*any\b", r"\bas\s+any\b", r"<any>"), "const x: any = y as any;", comments=C_LIKE),
    Rule("css_important", (r"!\s*important\b",), "a { color: red !important; }", comments=r"(?s)/\*.*?\*/"),
    Rule("sql_select_star", (r"(?i)\bSELECT\s+(?:DISTINCT\s+)?(?:[a-z_]+\.)?\*",), "SELECT * FROM t", comments=DASHES),
    # Python
    Rule("python_assert_validation", (r"(?m)^[ \t]*assert\s+(?:isinstance|len|request|user|[a-z_]+\s+is\s+not)",), "assert isinstance(x, int)", comments=PYTHON),
    Rule("python_async_blocking", (r"(?s)\basync\s+def\b.*?\b(?:time\.sleep|requests\.(?:get|post))\s*\(",), "async def f():\n    time.sleep(1)", comments=PYTHON),
    Rule("python_mark_safe", (_call("mark_safe|SafeString"),), "mark_safe(x)", comments=PYTHON),
    Rule("python_autoescape_off", (r"\bautoescape\s*=\s*False\b",), "Environment(autoescape=False)", comments=PYTHON),
    Rule("python_mutable_default", (r"\bdef\s+[A-Za-z_0-9]+\s*\([^)]*=\s*(?:\[\s*\]|\{\s*\}|set\(\)|list\(\)|dict\(\))",), "def f(a=[]): pass", comments=PYTHON),
    Rule("python_no_timeout", (r"\brequests\.(?:get|post|put|delete|head|patch)\s*\([^)\n]*\)",), "requests.get(u)", unless=(r"\btimeout\s*=",), gate=r"\brequests\.", comments=PYTHON, clean='requests.get(u, timeout=3)'),
    Rule("python_mixed_indent", (r"(?m)^ +\t|^\t+ ",), "if x:\n \ty()", comments=None),
    Rule("python_extract_all", (r"\.extractall\s*\(", r"\bunpack_archive\s*\("), "z.extractall(p)", comments=PYTHON),
    Rule("python_template_string", (r"\brender_template_string\s*\(\s*[^)\s]", r"\bTemplate\s*\(\s*(?:request|user|[a-z_]+)\b"), "render_template_string(s)", comments=PYTHON),
    Rule("python_ssl_no_verify", (r"_create_unverified_context\s*\(", r"check_hostname\s*=\s*False", r"verify_mode\s*=\s*ssl\.CERT_NONE"), "ssl._create_unverified_context()", comments=PYTHON),
    Rule("python_paramiko_auto_add", (r"\bAutoAddPolicy\s*\(", r"\bWarningPolicy\s*\("), "c.set_missing_host_key_policy(paramiko.AutoAddPolicy())", comments=PYTHON),
    Rule("python_weak_random", (r"\brandom\.(?:choice|choices|randint|random|getrandbits)\s*\(",), "token = random.randint(0, 9)", gate=r"(?i)\b(?:token|secret|password|otp|session|nonce)\b", comments=PYTHON),
    Rule("python_bind_all", (r"\.bind\s*\(\s*\(\s*['\"](?:0\.0\.0\.0)?['\"]", r"\bhost\s*=\s*['\"]0\.0\.0\.0['\"]"), "s.bind(('0.0.0.0', 80))", comments=r"(?m)#[^\n]*$"),
    Rule("python_hardcoded_key", (r"(?:AES\.new|Fernet|HMAC|hmac\.new)\s*\(\s*b['\"][^'\"\n]{8,}",), "AES.new(b'0123456789abcdef')", comments=r"(?m)#[^\n]*$"),
]
