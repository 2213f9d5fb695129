"""Code snippets appended to documents: at least one hit and one near miss per rule.

Credential-shaped values are put together here from parts, so that none is
stored as such.
"""

from __future__ import annotations

_ALNUM = "aK9xQ2mZ7pL4wR8tB3nV6cY1dF5gH0jS"
GOOGLE = "AI" + "za" + "Sy" + _ALNUM + "e"
AWS = "AK" + "IA" + "Q7Z2M4X9P1L8R3T6"
GITHUB = "gh" + "p_" + _ALNUM + "u7T2"
SLACK = "xo" + "xb-" + "81729304-" + _ALNUM[:20]
TOKEN = _ALNUM[:24]
SECRET = "Zq81" + _ALNUM[4:20]
PEM = "-----BEGIN " + "RSA PRIVATE" + " KEY-----"


def _gap(first: str, n: int, last: str) -> str:
    """Two lines exactly n lines apart."""
    return "\n".join([first] + ["  step();"] * (n - 1) + [last])


SNIPPETS: list[tuple[str, str]] = [
    ("Api.java", 'String u = "http://api.shop-data.io/v1/items?id=7";'),
    ("Api.java", 'String a = "http://schemas.android.com/apk/res/android"; b = "http://localhost:8080/x"; c = "https://safe.shop-data.io/x";'),
    ("Api.java", 'get("http://api.shop-data.io/v1/items?id=7"); get("HTTP://CDN.Assets-Host.net/a.js);");'),
    ("Mirror.java", 'load("http://mirror.brand12.net/f.bin", "http://mirror.local/f.bin", "http://...");'),
    ("res/xml/network_security_config.xml", '<base-config cleartextTrafficPermitted = "true"/>'),
    ("assets/other.txt", '<base-config cleartextTrafficPermitted="true"/>'),
    ("res/xml/rules.xml", '<domain-config cleartextTrafficPermitted="false"/>'),
    ("Trust.java", "public void checkServerTrusted(X509Certificate[] c, String t) { // accept\n }"),
    ("Trust.java", "public void checkServerTrusted(X509Certificate[] c, String t) { /* ok */ }\nvoid checkServerTrusted(A a) {}"),
    ("Trust.java", "public void checkServerTrusted(X509Certificate[] c, String t) { throw new CertificateException(); }"),
    ("smali/Trust.smali", ".method public checkServerTrusted([Ljava/security/cert/X509Certificate;)V\n    .locals 0\n    .prologue\n    return-void\n.end method"),
    ("Net.java", "sf = new TrustAllSSLSocketFactory(); tm = new TrustAllManager(); again = new TrustAllManager();"),
    ("Host.java", "client.setHostnameVerifier(SSLSocketFactory.ALLOW_ALL_HOSTNAME_VERIFIER); x = new AllowAllHostnameVerifier();"),
    ("Host.java", "public boolean verify(String h, SSLSession s) { return true; }"),
    ("Host.java", "c.setHostnameVerifier((host, session) -> true);"),
    ("Host.java", "public boolean verify(String h, SSLSession s) { return hv.verify(h, s); }"),
    ("Web.java", "public void onReceivedSslError(WebView v, SslErrorHandler handler, SslError e) { log(); handler.proceed(); }"),
    ("Web.java", "public void onReceivedSslError(WebView v, SslErrorHandler handler, SslError e) { handler.cancel(); }"),
    ("Tls.java", 'SSLContext ctx = SSLContext.getInstance("TLS"); ctx.init(null, new TrustManager[] { tm }, null);'),
    ("Web.java", "s.setAllowUniversalAccessFromFileURLs(true); s.setAllowFileAccessFromFileURLs( true );"),
    ("Web.java", "s.setMixedContentMode(WebSettings.MIXED_CONTENT_ALWAYS_ALLOW); t.setMixedContentMode(0);"),
    ("Web.java", "s.setAllowUniversalAccessFromFileURLs(false); s.setMixedContentMode(1);"),
    ("Ads.java", 'post("https://ads.doubleclick.net/track;v=1?x=2"); post("https://www.facebook.com/tr?id=1");'),
    ("Ads.java", "hosts: app-measurement.com, graph.facebook.com and mixpanel.com"),
    ("Ads.java", 'open("https://notadjust.com/page"); open("https://plain-host.org/adjust.com/x");'),
    ("Ads.java", "see xmixpanel.comet or flurrycom"),
    ("Host.java", 'open("https://api.other-vendor.com:8443/a/b"); open("https://play.google.com/store"); open("https://cdn.brand1.net/z");'),
    ("Host.java", 'open("https://api.other-vendor.com/second"), open("https://www.w3.org/2000/svg"), open("https://x.test/a");'),
    ("Store.java", 'openFileOutput("f.txt", Context.MODE_WORLD_READABLE); p = MODE_WORLD_WRITEABLE;'),
    ("Store.java", 'getSharedPreferences("p", 1); openOrCreateDatabase("d", 2 ); openFileOutput("g", 0);'),
    ("Store.java", 'getSharedPreferences("p", Context.MODE_PRIVATE); getSharedPreferences("q", 0);'),
    ("Sd.java", _gap("File f = Environment.getExternalStorageDirectory();", 3, 'write("user password");')),
    ("Sd.java", _gap("File g = Environment.getExternalStorageDirectory();", 4, 'write("user password");')),
    ("Sd.java", 'String path = "/sdcard/token.txt"; ctx.getExternalFilesDir(null);'),
    ("Prefs.java", 'editor.putString("auth_token", t); pref.putInt("launch_count", 2);'),
    ("Prefs.java", 'EncryptedSharedPreferences.create(); editor.putString("auth_token", t);'),
    ("Prefs.java", 'getSharedPreferences("user_session", MODE_PRIVATE); Editor.putLong("PIN_CODE", 1);'),
    ("Db.java", 'db.execSQL("CREATE TABLE u (id INT, password TEXT)"); db.execSQL("create table v (id INT, passwd TEXT, pin INT)");'),
    ("Db.java", 'import net.sqlcipher.database; db.execSQL("CREATE TABLE u (id INT, password TEXT)");'),
    ("Db.java", 'db.execSQL("CREATE TABLE w (id INT, title TEXT)");'),
    ("Log.java", 'Log.d(TAG, "token=" + userToken); System.out.println(secretValue);'),
    ("Log.java", 'Log.d(TAG, "started"); System.out.println(count);'),
    ("Cache.java", _gap("File c = new File(getCacheDir(), name);", 3, "String cvv = form.cvv();")),
    ("Cache.java", _gap("File c = new File(getCacheDir(), name);", 4, "String cvv = form.cvv();")),
    ("Cache.java", 'File t = File.createTempFile("credential", ".tmp");'),
    ("Enc.java", 'Cipher.getInstance("DES/CBC/PKCS5Padding"); Cipher.getInstance("DESede"); cipher.getinstance( \'RC4\');'),
    ("Enc.java", 'Cipher.getInstance("Blowfish"); Cipher.getInstance("DES/ECB/NoPadding");'),
    ("Enc.java", 'Cipher.getInstance("AES/ECB/PKCS5Padding"); Cipher.getInstance("AES"); Cipher.getInstance("AES/GCM/NoPadding");'),
    ("Iv.java", 'new IvParameterSpec("1234567890123456".getBytes()); new IvParameterSpec(new byte[] {1, 2, 3}); new IvParameterSpec(new byte[16]);'),
    ("Iv.java", "byte[] iv = new byte[16];" + " pad();" * 14 + " spec = new IvParameterSpec(iv);"),
    ("Iv.java", "byte[] iv = new byte[16];" + " pad();" * 30 + " spec = new IvParameterSpec(iv);"),
    ("Iv.java", "SecureRandom r = new SecureRandom(); r.nextBytes(b); new IvParameterSpec(b);"),
    ("Key.java", 'new SecretKeySpec("' + SECRET + '".getBytes(), "AES");'),
    ("Key.java", 'new SecretKeySpec(new byte[] {1,2,3,4,5,6,7,8,9}, "AES"); new SecretKeySpec(ks.get(), "AES");'),
    ("Hash.java", _gap('MessageDigest md = MessageDigest.getInstance("MD5");', 5, "md.update(password);")),
    ("Hash.java", _gap('MessageDigest md = MessageDigest.getInstance("MD5");', 6, "md.update(password);")),
    ("Hash.java", 'MessageDigest.getInstance("SHA-1"); // etag checksum\ncheck(login, signature);'),
    ("Hash.java", 'MessageDigest.getInstance("sha1"); // file checksum for the etag'),
    ("Rand.java", "SecureRandom sr = new SecureRandom(); sr.setSeed(42); sr.setSeed( seed );"),
    ("Rand.java", "Random r = new Random(7); r.setSeed(42);"),
    ("Rand.java", "new Random().nextBytes(sessionKey); int n = new Random().nextInt(6);"),
    ("Config.java", 'String k = "' + GOOGLE + '"; String k2 = "' + GOOGLE + '";'),
    ("Config.java", 'String k = "AI' + 'zaSyEXAMPLE_PLACEHOLDER_NOT_A_REAL_KEY0";'),
    ("Config.java", 'aws = "' + AWS + '"; old = "AK' + 'IAAAAAAAAAAAAAAAAA";'),
    ("Config.java", 'gh = "' + GITHUB + '"; sl = "' + SLACK + '";'),
    ("Config.java", 'api_key = "' + TOKEN + '"; token: "aaaaaaaaaaaaaaaaaaaaaa"; secret = "your_api_key_is_here"'),
    ("Config.java", 'password = "' + SECRET[:12] + '"; passwd = "changeit"; pwd = "short"; password = "example123"'),
    ("Config.java", "client_secret = '" + SECRET + "'; client_secret = 'dummy_dummy_dummy'"),
    ("Config.java", "url = \"mysql://app:" + SECRET[:10] + "@db.internal:3306/shop\"; u2 = \"redis://cache:6379/0\""),
    ("key.pem", PEM + "\nMIIB\n-----END" + " KEY-----"),
    ("Sdk.java", "import com.facebook.ads.AdView; import com.google.android.gms.ads.AdRequest;"),
    ("Sdk.java", "import com.appsflyer.AppsFlyerLib; import io.sentry.Sentry; import COM.MAPBOX.Maps;"),
    ("com/adjust/sdk/Adjust.java", "package com.adjust.sdk; class Adjust {}"),
    ("Ids.java", "tm.getDeviceId(); lm.getLastKnownLocation(p); tm.getImei();"),
    ("Plain.java", "class Plain { int add(int a, int b) { return a + b; } }"),
]
