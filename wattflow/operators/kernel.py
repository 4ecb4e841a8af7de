"""The innermost loops of ``trees`` beyond WHOLE_ROWS rows, as one function of Spark's JVMs.

SOURCE is Java, compiled by Janino, the compiler that Spark brings along for its
own generated code.  Its classes are added to the session as a jar and
registered as SQL functions:

* ``wattflow_sums``: sums of the open nodes, and of their bins;
* ``wattflow_cells``: sums per value in the bins of a node that may hold its best split;
* ``wattflow_rows``: drawn training rows, or test rows, by the node that they come to;
* ``wattflow_finish``: grows the rest of a tree below a node and predicts its test rows;
* ``wattflow_total``: sums the trees' means of each test row, in the order of the trees.

The first three take a block, trees, and the rows asked for of the block (from, to); the last two packets.
They do what ``bag_weights`` and ``grow`` do, with the same numbers: sums are of
integers, and scores are the same operations in the same order.  Blocks, trees
and packets are little-endian bytes; ``block`` and ``routed`` write the first two.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T

SOURCE = r"""
package wattflow.kernel;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;
import org.apache.spark.sql.Row;
import org.apache.spark.sql.RowFactory;

public class Kernel implements org.apache.spark.sql.api.java.UDF5 {
    private static final long serialVersionUID = 1L;

    public Object call(Object name, Object a, Object b, Object from, Object to) {
        String op = (String) name;
        if (op.equals("finish")) return new Grower().finish((scala.collection.Seq) a, ((Double) b).doubleValue());
        if (op.equals("total")) return Totals.result((scala.collection.Seq) a, ((Long) b).longValue());
        Reader block = new Reader((byte[]) a, ((Integer) from).intValue(), ((Integer) to).intValue()), trees = new Reader((byte[]) b, 0, 0);
        if (op.equals("sums")) return new NodeSums(block, trees).result();
        if (op.equals("cells")) return new Cells(block, trees).result();
        return new Rows(block, trees).result();
    }
}

final class Reader {
    final ByteBuffer b;
    final int from, to;  /* the rows of a block that are asked for */

    Reader(byte[] bytes, int from, int to) {
        b = ByteBuffer.wrap(bytes).order(ByteOrder.LITTLE_ENDIAN);
        this.from = from;
        this.to = to;
    }

    int one() { return b.getInt(); }

    int[] ints(int n) {
        int[] out = new int[n];
        b.asIntBuffer().get(out);
        b.position(b.position() + 4 * n);
        return out;
    }

    long[] longs(int n) {
        long[] out = new long[n];
        b.asLongBuffer().get(out);
        b.position(b.position() + 8 * n);
        return out;
    }

    double[] doubles(int n) {
        double[] out = new double[n];
        b.asDoubleBuffer().get(out);
        b.position(b.position() + 8 * n);
        return out;
    }

    static byte[] bytes(double[] a, int from, int to) {
        ByteBuffer out = ByteBuffer.allocate(8 * (to - from)).order(ByteOrder.LITTLE_ENDIAN);
        out.asDoubleBuffer().put(a, from, to - from);
        return out.array();
    }
}

/* A block's rows, led through the nodes of some trees. */
abstract class Pass {
    static final int CHUNK = 1000;
    final int n, features, trees, places;
    final long[] id;
    final double[] y, val;
    final int[] begin, col, number;
    final int[][] left, feature, place;
    final double[][] cut;
    final long salt;
    final double[] poisson;
    /* the inputs of the rows from..from + CHUNK */
    final double[] x;
    int from;

    Pass(Reader block, Reader state) {
        int all = block.one();
        features = block.one();
        int total = block.one(), head = block.b.position();
        n = Math.min(all, block.to) - block.from;
        block.b.position(head + 8 * block.from);
        id = block.longs(n);
        block.b.position(head + 8 * (all + block.from));
        y = block.doubles(n);
        block.b.position(head + 16 * all + 4 * block.from);
        begin = block.ints(n + 1);
        int first = begin[0];
        for (int i = 0; i <= n; i++) begin[i] -= first;
        head += 16 * all + 4 * (all + 1);
        block.b.position(head + 4 * first);
        col = block.ints(begin[n]);
        block.b.position(head + 4 * total + 8 * first);
        val = block.doubles(begin[n]);
        trees = state.one();
        places = state.one();
        poisson = state.doubles(state.one());
        salt = mixed(state.b.getLong());
        number = new int[trees];
        left = new int[trees][];
        feature = new int[trees][];
        place = new int[trees][];
        cut = new double[trees][];
        for (int t = 0; t < trees; t++) {
            number[t] = state.one();
            int nodes = state.one();
            left[t] = state.ints(nodes);
            feature[t] = state.ints(nodes);
            place[t] = state.ints(nodes);
            cut[t] = state.doubles(nodes);
        }
        x = new double[CHUNK * features];
    }

    static long mixed(long z) {
        z = (z ^ (z >>> 30)) * 0xBF58476D1CE4E5B9L;
        z = (z ^ (z >>> 27)) * 0x94D049BB133111EBL;
        return z ^ (z >>> 31);
    }

    abstract void take(int tree, int row, int place, int weight);

    void run() {
        for (from = 0; from < n; from += CHUNK) {
            int to = Math.min(n, from + CHUNK);
            Arrays.fill(x, 0.0);
            for (int r = from; r < to; r++)
                for (int j = begin[r]; j < begin[r + 1]; j++) x[(r - from) * features + col[j]] = val[j];
            for (int t = 0; t < trees; t++) chunk(t, to);
        }
    }

    private void chunk(int t, int to) {
        long add = (number[t] + 1L) * 0x9E3779B97F4A7C15L;
        int[] l = left[t], f = feature[t], p = place[t];
        double[] c = cut[t];
        for (int r = from; r < to; r++) {
            int w = 1;
            if (poisson.length > 0) {
                double u = (mixed((id[r] + add) ^ salt) >>> 11) * (1.0 / 9007199254740992.0);
                w = 0;
                while (w < poisson.length && poisson[w] <= u) w++;
                if (w == 0) continue;
            }
            int at = 0, row = (r - from) * features;
            while (l[at] >= 0) at = l[at] + (x[row + f[at]] > c[at] ? 1 : 0);
            if (p[at] >= 0) take(t, r, p[at], w);
        }
    }
}

/* A pass that knows the bins: 2k + 1 for a value that is edge k, 2k for one between the edges k - 1 and k. */
abstract class Binned extends Pass {
    final int wide;
    final int[] start, zero, code;

    Binned(Reader block, Reader state) {
        super(block, state);
        int[] sizes = state.ints(features);
        double[][] edges = new double[features][];
        start = new int[features + 1];
        zero = new int[features];
        for (int j = 0; j < features; j++) {
            edges[j] = state.doubles(sizes[j]);
            start[j + 1] = start[j] + 2 * sizes[j] + 1;
            zero[j] = start[j] + bin(edges[j], 0.0);
        }
        wide = start[features];
        code = new int[col.length];
        for (int i = 0; i < code.length; i++) code[i] = start[col[i]] + bin(edges[col[i]], val[i]);
    }

    static int bin(double[] edges, double v) {
        int lo = 0, hi = edges.length;
        while (lo < hi) {
            int mid = (lo + hi) >>> 1;
            if (edges[mid] < v) lo = mid + 1; else hi = mid;
        }
        return lo < edges.length && edges[lo] == v ? 2 * lo + 1 : 2 * lo;
    }
}

/* Of every open node: weight, target, its square, rows, least and largest target; and the first three for each bin, of inputs that are not 0. */
final class NodeSums extends Binned {
    final double[] own, least, most, sums;

    NodeSums(Reader block, Reader state) {
        super(block, state);
        own = new double[4 * places];
        least = new double[places];
        most = new double[places];
        sums = new double[3 * places * wide];
        Arrays.fill(least, Double.POSITIVE_INFINITY);
        Arrays.fill(most, Double.NEGATIVE_INFINITY);
    }

    void take(int t, int r, int k, int w) {
        double v = y[r], wy = w * v, wyy = wy * v;
        own[4 * k] += w;
        own[4 * k + 1] += wy;
        own[4 * k + 2] += wyy;
        own[4 * k + 3] += 1;
        if (v < least[k]) least[k] = v;
        if (v > most[k]) most[k] = v;
        int s = 3 * wide * k;
        for (int j = begin[r], end = begin[r + 1]; j < end; j++) {
            int c = s + 3 * code[j];
            sums[c] += w;
            sums[c + 1] += wy;
            sums[c + 2] += wyy;
        }
    }

    Object result() {
        run();
        int many = 0;
        for (int k = 0; k < places; k++) if (own[4 * k + 3] > 0) many++;
        Row[] out = new Row[many];
        many = 0;
        for (int k = 0; k < places; k++)
            if (own[4 * k + 3] > 0)
                out[many++] = RowFactory.create(new Object[] {Integer.valueOf(k), Reader.bytes(own, 4 * k, 4 * k + 4),
                    Double.valueOf(least[k]), Double.valueOf(most[k]), Reader.bytes(sums, 3 * wide * k, 3 * wide * (k + 1))});
        return out;
    }
}

/* Of every node: bin, value, weight and target of the values in its marked bins, equal values folded. */
final class Cells extends Binned {
    final byte[] mark;
    final int[][] zeros;
    final double[] zw, zy;
    int many = 0;
    int[] node = new int[1024], bin = new int[1024];
    double[] v = new double[1024], w = new double[1024], wy = new double[1024];

    Cells(Reader block, Reader state) {
        super(block, state);
        mark = new byte[places * wide];
        state.b.get(mark);
        zeros = new int[places][];
        for (int k = 0; k < places; k++) {
            int some = 0;
            int[] list = new int[features];
            for (int j = 0; j < features; j++) if (mark[k * wide + zero[j]] != 0) list[some++] = j;
            zeros[k] = Arrays.copyOf(list, some);
        }
        zw = new double[places * features];
        zy = new double[places * features];
    }

    void add(int k, int c, double value, double weight, double target) {
        if (many == node.length) {
            int size = 2 * many;
            node = Arrays.copyOf(node, size);
            bin = Arrays.copyOf(bin, size);
            v = Arrays.copyOf(v, size);
            w = Arrays.copyOf(w, size);
            wy = Arrays.copyOf(wy, size);
        }
        node[many] = k;
        bin[many] = c;
        v[many] = value;
        w[many] = weight;
        wy[many++] = target;
    }

    void take(int t, int r, int k, int weight) {
        double target = weight * y[r];
        int s = k * wide;
        for (int j = begin[r], end = begin[r + 1]; j < end; j++)
            if (mark[s + code[j]] != 0) add(k, code[j], val[j], weight, target);
        int[] list = zeros[k];
        for (int i = 0; i < list.length; i++)
            if (x[(r - from) * features + list[i]] == 0) {
                zw[k * features + list[i]] += weight;
                zy[k * features + list[i]] += target;
            }
    }

    Object result() {
        run();
        for (int k = 0; k < places; k++)
            for (int j = 0; j < features; j++)
                if (zw[k * features + j] > 0) add(k, zero[j], 0.0, zw[k * features + j], zy[k * features + j]);
        long[] key = new long[many], key2 = new long[many];
        int[] at = new int[many], at2 = new int[many];
        for (int i = 0; i < many; i++) at[i] = i;
        for (int by = 0; by < 3; by++) {
            for (int i = 0; i < many; i++) key[i] = by == 0 ? Sort.bits(v[at[i]]) : by == 1 ? bin[at[i]] : node[at[i]];
            Sort.sort(key, at, key2, at2, many);
        }
        Row[] out = new Row[places];
        int nodes = 0, i = 0;
        double[][] cells = new double[4][many];
        while (i < many) {
            int k = node[at[i]], n = 0;
            for (; i < many && node[at[i]] == k; i++) {
                int c = at[i];
                if (n > 0 && cells[0][n - 1] == bin[c] && cells[1][n - 1] == v[c]) {
                    cells[2][n - 1] += w[c];
                    cells[3][n - 1] += wy[c];
                } else {
                    cells[0][n] = bin[c];
                    cells[1][n] = v[c];
                    cells[2][n] = w[c];
                    cells[3][n++] = wy[c];
                }
            }
            double[] all = new double[4 * n];
            for (int j = 0; j < 4; j++) System.arraycopy(cells[j], 0, all, j * n, n);
            out[nodes++] = RowFactory.create(new Object[] {Integer.valueOf(k), Reader.bytes(all, 0, 4 * n)});
        }
        return Arrays.copyOf(out, nodes);
    }
}

/* The rows that come to each place, as packets: kind, tree, rows, features, 1 for a feature of doubles (0: of floats that say the same);
   of a row: target or id, weight, number of inputs that are not 0, and these. */
final class Rows extends Pass {
    final byte[] flags;
    final ByteBuffer[] packets;
    final int[] rows;
    final boolean tests;

    Rows(Reader block, Reader state) {
        super(block, state);
        tests = state.one() == 1;
        flags = new byte[features];
        for (int i = 0; i < val.length; i++) if ((double) (float) val[i] != val[i]) flags[col[i]] = 1;
        packets = new ByteBuffer[places];
        rows = new int[places];
    }

    void take(int t, int r, int k, int w) {
        ByteBuffer p = packets[k];
        int need = 11 + 10 * (begin[r + 1] - begin[r]);
        if (p == null) {
            p = ByteBuffer.allocate(16 + features + 16 * need).order(ByteOrder.LITTLE_ENDIAN);
            p.putInt(tests ? 1 : 0).putInt(number[t]).putInt(0).putInt(features);
            p.put(flags);
            packets[k] = p;
        } else if (p.remaining() < need) {
            p = ByteBuffer.allocate(2 * p.capacity() + need).order(ByteOrder.LITTLE_ENDIAN);
            p.put(packets[k].array(), 0, packets[k].position());
            packets[k] = p;
        }
        rows[k]++;
        if (tests) p.putLong(id[r]); else p.putDouble(y[r]);
        p.put((byte) w).putShort((short) (begin[r + 1] - begin[r]));
        for (int j = begin[r], end = begin[r + 1]; j < end; j++) {
            p.putShort((short) col[j]);
            if (flags[col[j]] == 1) p.putDouble(val[j]); else p.putFloat((float) val[j]);
        }
    }

    Object result() {
        run();
        int many = 0;
        for (int k = 0; k < places; k++) if (rows[k] > 0) many++;
        Row[] out = new Row[many];
        many = 0;
        for (int k = 0; k < places; k++)
            if (rows[k] > 0) {
                packets[k].putInt(8, rows[k]);
                out[many++] = RowFactory.create(new Object[] {Integer.valueOf(k), Arrays.copyOf(packets[k].array(), packets[k].position())});
                packets[k] = null;
            }
        return out;
    }
}

/* Means of test rows: a packet has a tree, and of 2 ** BITS ids the last bits and means of some. */
final class Totals {
    static final int BITS = 17, LAST = (1 << BITS) - 1;

    static Row[] packets(int tree, long[] tid, double[] mean) {
        int n = tid.length, many = 0;
        long[] key = Arrays.copyOf(tid, n);
        int[] at = new int[n];
        for (int i = 0; i < n; i++) at[i] = i;
        Sort.sort(key, at, new long[n], new int[n], n);
        for (int i = 0; i < n; i++) if (i == 0 || key[i] >>> BITS != key[i - 1] >>> BITS) many++;
        Row[] out = new Row[many];
        many = 0;
        for (int i = 0, end; i < n; i = end) {
            for (end = i; end < n && key[end] >>> BITS == key[i] >>> BITS; ) end++;
            ByteBuffer p = ByteBuffer.allocate(8 + 12 * (end - i)).order(ByteOrder.LITTLE_ENDIAN);
            p.putInt(tree).putInt(end - i);
            for (int j = i; j < end; j++) p.putInt((int) key[j] & LAST);
            for (int j = i; j < end; j++) p.putDouble(mean[at[j]]);
            out[many++] = RowFactory.create(new Object[] {Long.valueOf(key[i] >>> BITS), p.array()});
        }
        return out;
    }

    /* Of each id its first tree, and the sum of its means in the order of the trees. */
    static Row[] result(scala.collection.Seq packets, long part) {
        int n = packets.length(), many = 0;
        long[] key = new long[n];
        int[] at = new int[n];
        for (int i = 0; i < n; i++) {
            key[i] = new Reader((byte[]) packets.apply(i), 0, 0).one();
            at[i] = i;
        }
        Sort.sort(key, at, new long[n], new int[n], n);
        int[] first = new int[LAST + 1];
        double[] total = new double[LAST + 1];
        Arrays.fill(first, -1);
        for (int i = 0; i < n; i++) {
            Reader p = new Reader((byte[]) packets.apply(at[i]), 0, 0);
            int tree = p.one(), rows = p.one();
            int[] id = p.ints(rows);
            double[] mean = p.doubles(rows);
            for (int j = 0; j < rows; j++) {
                if (first[id[j]] < 0) {
                    first[id[j]] = tree;
                    many++;
                }
                total[id[j]] += mean[j];
            }
        }
        Row[] out = new Row[many];
        many = 0;
        for (int i = 0; i <= LAST; i++)
            if (first[i] >= 0) out[many++] = RowFactory.create(new Object[] {Long.valueOf(part << BITS | i), Integer.valueOf(first[i]), Double.valueOf(total[i])});
        return out;
    }
}

final class Sort {
    static final int WIDTH = 11, DIGITS = 6, MASK = 2047, FEW = 1500;

    /* in the order of the numbers, without a sign; -0 is 0 */
    static long bits(double v) {
        long b = Double.doubleToLongBits(v + 0.0);
        return b < 0 ? ~b : b | Long.MIN_VALUE;
    }

    /* keys (without a sign) and what goes with them; stable */
    static void sort(long[] key, int[] at, long[] key2, int[] at2, int n) {
        if (n < FEW) merge(key, at, key2, at2, n); else radix(key, at, key2, at2, n);
    }

    private static void radix(long[] key, int[] at, long[] key2, int[] at2, int n) {
        int[][] count = new int[DIGITS][MASK + 1];
        for (int i = 0; i < n; i++) {
            long k = key[i];
            for (int d = 0; d < DIGITS; d++) count[d][(int) (k >>> d * WIDTH) & MASK]++;
        }
        long[] fk = key, tk = key2;
        int[] fa = at, ta = at2;
        for (int d = 0; d < DIGITS; d++) {
            int[] c = count[d];
            int shift = d * WIDTH, sum = 0;
            if (c[(int) (fk[0] >>> shift) & MASK] == n) continue;
            for (int i = 0; i <= MASK; i++) {
                int k = c[i];
                c[i] = sum;
                sum += k;
            }
            for (int i = 0; i < n; i++) {
                int to = c[(int) (fk[i] >>> shift) & MASK]++;
                tk[to] = fk[i];
                ta[to] = fa[i];
            }
            long[] k = fk;
            fk = tk;
            tk = k;
            int[] a = fa;
            fa = ta;
            ta = a;
        }
        if (fk != key) {
            System.arraycopy(fk, 0, key, 0, n);
            System.arraycopy(fa, 0, at, 0, n);
        }
    }

    private static void merge(long[] key, int[] at, long[] key2, int[] at2, int n) {
        for (int s = 0; s < n; s += 16)
            for (int i = s + 1; i < n && i < s + 16; i++) {
                long k = key[i], u = k + Long.MIN_VALUE;
                int a = at[i], j = i;
                for (; j > s && key[j - 1] + Long.MIN_VALUE > u; j--) {
                    key[j] = key[j - 1];
                    at[j] = at[j - 1];
                }
                key[j] = k;
                at[j] = a;
            }
        long[] fk = key, tk = key2;
        int[] fa = at, ta = at2;
        for (int run = 16; run < n; run *= 2) {
            for (int s = 0; s < n; s += 2 * run) {
                int m = Math.min(n, s + run), e = Math.min(n, s + 2 * run), i = s, j = m;
                for (int o = s; o < e; o++)
                    if (j >= e || i < m && fk[i] + Long.MIN_VALUE <= fk[j] + Long.MIN_VALUE) {
                        tk[o] = fk[i];
                        ta[o] = fa[i++];
                    } else {
                        tk[o] = fk[j];
                        ta[o] = fa[j++];
                    }
            }
            long[] k = fk;
            fk = tk;
            tk = k;
            int[] a = fa;
            fa = ta;
            ta = a;
        }
        if (fk != key) {
            System.arraycopy(fk, 0, key, 0, n);
            System.arraycopy(fa, 0, at, 0, n);
        }
    }
}

/* The rest of one tree below a node: the rule of grow() in trees.py, a node at a time.

   Every feature has its entries (rank of the value, row) in order, those of a node next to each other; a sparse feature only
   those that are not 0.  A split parts them all. */
final class Grower {
    static final int[] CLOSER = {32768, 4096, 512};
    int m = 0, tests = 0, features = 0, tree = 0, live = 0;
    double[] target, sums;  /* weight and weighted target of a row, side by side */
    long[] tid;
    double[][] value, tx;  /* of a feature: the values by rank, and the test rows' inputs */
    long[][] entry;
    int[] zero, column;
    /* begin and end of the node's rows and tests; begin and end of each feature's entries (begin -1: they do not differ) */
    int[] now;
    int[] ids, ids2, test;
    int[][] spare = new int[4][];
    int spares = 0;
    int[] number;
    byte[] side;
    long[] other;
    double[] mean;
    double sw, sy, best, least;
    int at, leftRank, rightRank;

    Row[] finish(scala.collection.Seq packets, double sparse) {
        int many = packets.length();
        ByteBuffer[] all = new ByteBuffer[many];
        for (int i = 0; i < many; i++) {
            ByteBuffer p = ByteBuffer.wrap((byte[]) packets.apply(i)).order(ByteOrder.LITTLE_ENDIAN);
            all[i] = p;
            tree = p.getInt(4);
            features = p.getInt(12);
            if (p.getInt(0) == 0) m += p.getInt(8); else tests += p.getInt(8);
        }
        if (m == 0 || tests == 0) return new Row[0];
        double[][] x = read(all, sparse);
        mean = new double[tests];
        if (x != null) grow();
        return Totals.packets(tree, tid, mean);
    }

    private static void skip(ByteBuffer p, byte[] flags, int[] count) {
        for (int e = p.getShort() & 0xffff; e > 0; e--) {
            int c = p.getShort() & 0xffff;
            count[c]++;
            p.position(p.position() + (flags[c] == 1 ? 8 : 4));
        }
    }

    private double[][] read(ByteBuffer[] all, double sparse) {
        int[] count = new int[features], tcount = new int[features];
        byte[][] flags = new byte[all.length][features];
        for (int i = 0; i < all.length; i++) {
            ByteBuffer p = all[i];
            p.position(16);
            p.get(flags[i]);
            for (int r = p.getInt(8); r > 0; r--) {
                p.position(p.position() + 9);
                skip(p, flags[i], p.getInt(0) == 0 ? count : tcount);
            }
        }
        target = new double[m];
        sums = new double[2 * m];
        tid = new long[tests];
        double[][] x = new double[features][];
        int[][] row = new int[features][];
        tx = new double[features][];
        for (int j = 0; j < features; j++) {
            x[j] = new double[count[j]];
            row[j] = new int[count[j]];
            if (count[j] > 0) tx[j] = new double[tests];
            count[j] = 0;
        }
        int r = 0, t = 0;
        for (int i = 0; i < all.length; i++) {
            ByteBuffer p = all[i];
            p.position(16 + features);
            boolean train = p.getInt(0) == 0;
            for (int left = p.getInt(8); left > 0; left--) {
                if (train) target[r] = p.getDouble(); else tid[t] = p.getLong();
                int w = p.get();
                if (train) {
                    sums[2 * r] = w;
                    sums[2 * r + 1] = w * target[r];
                }
                for (int e = p.getShort() & 0xffff; e > 0; e--) {
                    int c = p.getShort() & 0xffff;
                    double v = flags[i][c] == 1 ? p.getDouble() : p.getFloat();
                    if (train) {
                        x[c][count[c]] = v;
                        row[c][count[c]++] = r;
                    } else if (tx[c] != null) tx[c][t] = v;
                }
                if (train) r++; else t++;
            }
            all[i] = null;
        }
        order(x, row, count, sparse);
        return x;
    }

    private void order(double[][] x, int[][] row, int[] count, double sparse) {
        value = new double[features][];
        entry = new long[features][];
        zero = new int[features];
        column = new int[features];
        now = new int[4 + 2 * features];
        double[] v = new double[m];
        long[] key = new long[m], key2 = new long[m];
        int[] at = new int[m], at2 = new int[m];
        long nought = Sort.bits(0.0);
        for (int j = 0; j < features; j++) {
            int n = count[j];
            double[] c = x[j];
            double lo = n < m ? 0 : Double.POSITIVE_INFINITY, hi = n < m ? 0 : Double.NEGATIVE_INFINITY;
            for (int i = 0; i < n; i++) {
                lo = Math.min(lo, c[i]);
                hi = Math.max(hi, c[i]);
            }
            x[j] = null;
            int[] rows = row[j];
            row[j] = null;
            if (!(lo < hi)) {
                tx[j] = null;
                continue;
            }
            boolean few = n < sparse * m;
            Arrays.fill(v, 0.0);
            for (int i = 0; i < n; i++) {
                v[rows[i]] = c[i];
                key[i] = Sort.bits(c[i]);
                at[i] = rows[i];
            }
            if (!few) {
                n = m;
                for (int i = 0; i < m; i++) {
                    key[i] = Sort.bits(v[i]);
                    at[i] = i;
                }
            }
            Sort.sort(key, at, key2, at2, n);
            double[] values = new double[n + 1];
            long[] e = new long[n];
            int rank = -1, z = -1;
            for (int i = 0; i < n; i++) {
                if (few && z < 0 && key[i] + Long.MIN_VALUE > nought + Long.MIN_VALUE) {
                    z = ++rank;
                    values[rank] = 0;
                }
                if (i == 0 || key[i] != key[i - 1]) values[++rank] = v[at[i]];
                e[i] = (long) rank << 32 | at[i];
            }
            if (few && z < 0) {
                z = ++rank;
                values[rank] = 0;
            }
            value[live] = Arrays.copyOf(values, rank + 1);
            entry[live] = e;
            zero[live] = z;
            column[live] = j;
            now[4 + 2 * live] = 0;
            now[5 + 2 * live] = n;
            live++;
        }
    }

    private void grow() {
        ids = new int[m];
        ids2 = new int[m];
        test = new int[tests];
        side = new byte[m];
        number = new int[m];
        other = new long[m];
        for (int i = 0; i < m; i++) ids[i] = i;
        for (int i = 0; i < tests; i++) test[i] = i;
        now[1] = m;
        now[3] = tests;
        below(0);
    }

    /* All nodes from this one on. */
    private void below(int closer) {
        int[][] stack = new int[32][];
        int top = 0;
        while (true) {
            int[] wait = null;
            at = -1;
            if (closer < CLOSER.length && now[1] - now[0] <= CLOSER[closer]) packed(closer);
            else {
                if (find()) wait = split();
                else for (int i = now[2]; i < now[3]; i++) mean[test[i]] = sy / sw;
            }
            if (wait != null) {
                if (top == stack.length) stack = (int[][]) Arrays.copyOf(stack, 2 * top);
                stack[top++] = wait;
            }
            if (at < 0) {
                if (top == 0) return;
                keep(now);
                now = stack[--top];
                stack[top] = null;
            }
        }
    }

    /* The same for a node whose rows are first put next to each other, so that they stay in the processor's cache. */
    private void packed(int closer) {
        int b = now[0], n = now[1] - b;
        double[] s = sums, t = target, s2 = new double[2 * n], t2 = new double[n];
        byte[] own = side;
        for (int i = 0; i < n; i++) {
            int k = ids[b + i];
            number[k] = i;
            s2[2 * i] = s[2 * k];
            s2[2 * i + 1] = s[2 * k + 1];
            t2[i] = t[k];
            ids[b + i] = i;
        }
        for (int f = 0; f < live; f++) {
            long[] e = entry[f];
            if (now[4 + 2 * f] >= 0)
                for (int i = now[4 + 2 * f], end = now[5 + 2 * f]; i < end; i++) e[i] = e[i] >>> 32 << 32 | number[(int) e[i]];
        }
        sums = s2;
        target = t2;
        side = new byte[n];
        below(closer + 1);
        sums = s;
        target = t;
        side = own;
        at = -1;
    }

    private boolean find() {
        double lo = Double.POSITIVE_INFINITY, hi = Double.NEGATIVE_INFINITY, w = 0, y = 0;
        for (int i = now[0], end = now[1]; i < end; i++) {
            int k = ids[i];
            double v = target[k];
            w += sums[2 * k];
            y += sums[2 * k + 1];
            if (v < lo) lo = v;
            if (v > hi) hi = v;
        }
        sw = w;
        sy = y;
        at = -1;
        best = Double.NEGATIVE_INFINITY;
        least = Double.NEGATIVE_INFINITY;
        if (lo < hi)
            for (int f = 0; f < live; f++) {
                int b = now[4 + 2 * f], e = now[5 + 2 * f];
                if (b >= 0 && b < e) {
                    if (e - b == now[1] - now[0]) dense(f); else sparse(f);
                }
            }
        return at >= 0;
    }

    private int[] frame() { return spares > 0 ? spare[--spares] : new int[4 + 2 * live]; }

    private void keep(int[] frame) { if (spares < spare.length && frame.length == 4 + 2 * live) spare[spares++] = frame; }

    /* A split is scored only if products say that it may be better. */
    private void consider(int f, int l, int r, double lw, double ly) {
        double rw = sw - lw, ry = sy - ly;
        if (!(ly * ly * rw + ry * ry * lw < least * (lw * rw))) {
            double score = ly * ly / lw + ry * ry / rw;
            if (score > best) {
                best = score;
                least = score * (1 - 1e-9);
                at = f;
                leftRank = l;
                rightRank = r;
            }
        }
    }

    private void dense(int f) {
        long[] e = entry[f];
        int b = now[4 + 2 * f], last = now[5 + 2 * f] - 1;
        if (e[b] >>> 32 == e[last] >>> 32) {
            now[4 + 2 * f] = -1;
            return;
        }
        final double[] s = sums;
        final double tw = sw, ty = sy;
        double lw = 0, ly = 0;
        long here = e[b];
        for (int i = b; i < last; i++) {
            int k = 2 * (int) here;
            long next = e[i + 1];
            lw += s[k];
            ly += s[k + 1];
            if ((here ^ next) >>> 32 != 0) {
                double rw = tw - lw, ry = ty - ly;
                if (!(ly * ly * rw + ry * ry * lw < least * (lw * rw))) consider(f, (int) (here >>> 32), (int) (next >>> 32), lw, ly);
            }
            here = next;
        }
    }

    private void sparse(int f) {
        long[] e = entry[f];
        int b = now[4 + 2 * f], end = now[5 + 2 * f], z = zero[f], before = -1;
        boolean done = false;
        double zw = sw, zy = sy, lw = 0, ly = 0;
        for (int i = b; i < end; i++) {
            int k = 2 * (int) e[i];
            zw -= sums[k];
            zy -= sums[k + 1];
        }
        for (int i = b; i < end; i++) {
            int rank = (int) (e[i] >>> 32), k = 2 * (int) e[i];
            if (!done && rank > z) {
                if (before >= 0) consider(f, before, z, lw, ly);
                lw += zw;
                ly += zy;
                done = true;
                consider(f, z, rank, lw, ly);
            } else if (before >= 0 && before != rank) consider(f, before, rank, lw, ly);
            lw += sums[k];
            ly += sums[k + 1];
            before = rank;
        }
        if (!done) consider(f, before, z, lw, ly);
    }

    /* Goes to a part of the node, the smaller one of two, and returns the other; parts without test rows are not grown. */
    private int[] split() {
        double low = value[at][leftRank], high = value[at][rightRank], cut = (low + high) / 2;
        if (!(cut < high)) cut = low;
        int b = now[0], e = now[1], tb = now[2], te = now[3], tm = tb, back = te;
        double[] c = tx[column[at]];
        while (tm < back) {
            int k = test[tm];
            if (c[k] > cut) {
                test[tm] = test[--back];
                test[back] = k;
            } else tm++;
        }
        boolean left = tm > tb, right = te > tm;
        int fm = sides();
        int nl = b, nr = 0;
        for (int i = b; i < e; i++) {
            int k = ids[i], s = side[k];
            ids[nl] = k;
            ids2[nr] = k;
            nl += 1 - s;
            nr += s;
        }
        System.arraycopy(ids2, 0, ids, nl, nr);
        boolean goRight = left && right ? nr < nl - b : right;
        int[] go = frame(), wait = left && right ? frame() : null;
        go[0] = goRight ? nl : b;
        go[1] = goRight ? e : nl;
        go[2] = goRight ? tm : tb;
        go[3] = goRight ? te : tm;
        if (wait != null) {
            wait[0] = goRight ? b : nl;
            wait[1] = goRight ? nl : e;
            wait[2] = goRight ? tb : tm;
            wait[3] = goRight ? tm : te;
        }
        for (int f = 0; f < live; f++) {
            int ob = now[4 + 2 * f], oe = now[5 + 2 * f];
            if (ob < 0) {
                go[4 + 2 * f] = -1;
                if (wait != null) wait[4 + 2 * f] = -1;
                continue;
            }
            int om = f == at ? fm : parted(entry[f], ob, oe, right);
            go[4 + 2 * f] = goRight ? om : ob;
            go[5 + 2 * f] = goRight ? oe : om;
            if (wait != null) {
                wait[4 + 2 * f] = goRight ? ob : om;
                wait[5 + 2 * f] = goRight ? om : oe;
            }
        }
        keep(now);
        now = go;
        return wait;
    }

    /* Sets the sides of the node's rows; where the right ones begin among the entries of the feature that is split. */
    private int sides() {
        long[] e = entry[at];
        int b = now[4 + 2 * at], end = now[5 + 2 * at], m = b, hi = end;
        if (end - b < now[1] - now[0]) {
            byte s = (byte) (zero[at] > leftRank ? 1 : 0);
            for (int i = now[0]; i < now[1]; i++) side[ids[i]] = s;
        }
        while (m < hi) {
            int mid = (m + hi) >>> 1;
            if ((int) (e[mid] >>> 32) <= leftRank) m = mid + 1; else hi = mid;
        }
        for (int i = b; i < m; i++) side[(int) e[i]] = 0;
        for (int i = m; i < end; i++) side[(int) e[i]] = 1;
        return m;
    }

    /* Left entries before right ones, each in their order. */
    private int parted(long[] e, int b, int end, boolean right) {
        final byte[] s = side;
        final long[] o = other;
        int m = b, moved = 0;
        for (int i = b; i < end; i++) {
            long k = e[i];
            int r = s[(int) k];
            e[m] = k;
            o[moved] = k;
            m += 1 - r;
            moved += r;
        }
        if (right) System.arraycopy(o, 0, e, m, moved);
        return m;
    }
}
"""

RESULTS = {"sums": "array<struct<nid:int,own:binary,lo:double,hi:double,sums:binary>>", "cells": "array<struct<nid:int,cells:binary>>",
           "rows": "array<struct<unit:int,packet:binary>>", "finish": "array<struct<part:bigint,packet:binary>>", "total": "array<struct<_tid:bigint,first:int,total:double>>"}
CLASS = "wattflow.kernel.Kernel"
ENTRY = np.dtype([("col", "<u2"), ("val", "<f8")])


def registered(spark: SparkSession) -> None:
    """The functions of SOURCE, known to the session and its executors by a jar."""
    session, jvm, gateway = spark._jsparkSession, spark._jvm, spark.sparkContext._gateway
    if session.catalog().functionExists("wattflow_finish"):
        return
    kind = getattr(jvm.java.lang, "Class")
    compiler = jvm.org.codehaus.janino.SimpleCompiler()
    compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
    compiler.cook(SOURCE)
    codes = compiler.getBytecodes()
    folder = tempfile.mkdtemp(prefix="wattflow-jar-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # a name of its own, as a session takes a jar of one name once
    jar = os.path.join(folder, os.path.basename(folder) + ".jar")
    with zipfile.ZipFile(jar, "w") as z:
        for name in codes.keySet():
            z.writestr(name.replace(".", "/") + ".class", bytes(codes.get(name)))
    spark.sql(f"ADD JAR '{jar}'")
    loader = jvm.java.lang.Thread.currentThread().getContextClassLoader()
    made = (kind.forName(CLASS, True, loader).getDeclaredConstructor(gateway.new_array(kind, 0))
            .newInstance(gateway.new_array(jvm.java.lang.Object, 0)))
    for op, result in RESULTS.items():
        session.udf().register(f"wattflow_{op}", made, session.parseDataType(T._parse_datatype_string(result).json()))


PART = 1 << 17  # 2 ** BITS of SOURCE


def means(tree: int, ids: np.ndarray, mean: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Parts and packets of test rows' means, as ``wattflow_finish`` gives them."""
    parts = np.unique(ids // PART)
    some = [np.flatnonzero(ids // PART == part) for part in parts]
    return parts.tolist(), [_bytes(([tree, len(i)], "<i4"), (ids[i] % PART, "<i4"), (mean[i], "<f8")) for i in some]


def packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each row begins, and its inputs that are not 0 with their columns."""
    r, c = np.nonzero(x)
    entries = np.empty(len(r), ENTRY)
    entries["col"], entries["val"] = c, x[r, c]
    return np.r_[0, np.cumsum(np.bincount(r, minlength=len(x)))], entries


def unpacked(begin: np.ndarray, entries: np.ndarray, features: int) -> np.ndarray:
    x = np.zeros((len(begin) - 1, features))
    x[np.repeat(np.arange(len(x)), np.diff(begin)), entries["col"]] = entries["val"]
    return x


def _bytes(*parts) -> bytes:
    return b"".join(np.ascontiguousarray(p, kind).tobytes() for p, kind in parts)


def block(features: int, ids: np.ndarray, y: np.ndarray | None, begin: np.ndarray, entries: np.ndarray) -> bytes:
    """Rows as the functions take them (test rows: their ids, no target)."""
    return _bytes(([len(ids), features, len(entries)], "<i4"), (ids, "<i8"), (np.zeros(len(ids)) if y is None else y, "<f8"),
                  (begin, "<i4"), (entries["col"], "<i4"), (entries["val"], "<f8"))


def routed(trees: list[tuple], places: int, poisson: np.ndarray | None, seed: int) -> bytes:
    """Trees as the functions take them: of each its number, and left child (-1: none), feature, place (-1: none) and cut of its nodes."""
    out = [_bytes(([len(trees), places, 0 if poisson is None else len(poisson)], "<i4"), ([] if poisson is None else poisson, "<f8"),
                  ([seed], "<i8"))]
    for number, left, feature, place, cut in trees:
        out.append(_bytes(([number, len(left)], "<i4"), (left, "<i4"), (feature, "<i4"), (place, "<i4"), (cut, "<f8")))
    return b"".join(out)
